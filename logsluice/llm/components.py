"""Connected components by alternating large and small stars, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.scale import saved


def _hub_of(pairs: DataFrame) -> DataFrame:
    """With each node ``a`` the smallest of itself and its neighbours ``b``."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub"))
    return pairs.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _hub_of(both).where("b > a").select(F.col("b").alias("a"), F.col("hub").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _hub_of(down)
    hubs = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("hub").alias("b"))
    return hubs.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes of ``edges`` (``a``, ``b``).

    Every round keeps the components and brings nodes nearer to the smallest one; it ends when a
    round changes nothing. Edges from a node to itself are ignored; nodes without others do not
    appear. Nodes need an order, and no row is dropped however many neighbours a node has.
    """
    now = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = saved(_small_star(_large_star(now).distinct()).distinct(), "edges")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]
