"""A Merkle manifest of a table: every row a leaf, a tree for each group, and one tree over the groups' roots.

Nodes are hex digits. A level of a tree is cut into aligned blocks, and each block keeps its part
of a level as one string: the digits of its nodes, one after the other. Substrings of a run's width
are hashed to the next level's string, until the block is one node; the substrings beside a node's
place are its siblings there. Blocks are the nodes of the next round, so a group of any size is
built in a few rounds, and its paths come back down from block to block. Hashing and paths are SQL
expressions; only leaves are shuffled, never the rows they stand for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.scale import saved

#: Hex digits of a node.
DIGITS = 64
#: Levels that a block holds; it has ``arity ** LEVELS`` nodes at most.
LEVELS = 8


@dataclass(frozen=True)
class Manifest:
    """``rows``: ``row`` (a struct of what was kept of it), ``leaf``, ``claimed``, ``subroot``, ``root``, ``path``.

    ``path`` lists the siblings beside the row's node from its leaf to the root, as the digits to its
    left and to its right. Hashing ``leaf`` with them, level by level, gives ``root``.
    """

    rows: DataFrame


def node(*parts: Column) -> Column:
    """The hash of joined texts or bytes, as hex digits."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def field(value: Column) -> Column:
    """A value as its size in UTF-8 bytes, a colon and its text; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return node(*map(field, values))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their ``place`` in their group, from 0, and the group's ``size``.

    Rows are sorted by ranges, stored, and numbered from the counts of each range, so that no
    group has to fit into one task. Rows that are equal in ``order`` may stand either way.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    by = (group, *order, "tie")
    ranges = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    held = saved(ranges.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    runs = held.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")
    size = F.sum("n").over(Window.partitionBy(group))
    shifts = runs.select(group, "part", (before - F.col("first")).alias("shift"), size.alias("size"))
    placed = held.join(shifts, [group, "part"])
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "size")


def _depth(size: Column, arity: int) -> Column:
    """Levels above ``size`` nodes in a block: as many as a whole block has if there are others beside it."""
    return sum(((size > arity**k).cast("int") for k in range(LEVELS)), F.lit(0))


def _parents(level: Column, arity: int) -> Column:
    width = DIGITS * arity
    runs = F.sequence(F.lit(0), ((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: node(F.substr(level, i * width + 1, F.lit(width)))), "").cast("binary")


def _siblings(levels: Column, depth: Column, place: Column, arity: int) -> Column:
    """What stands to the left and to the right of a node in its run, level by level."""

    def beside(level: Column, height: Column) -> Column:
        at = (place / F.pow(F.lit(arity), height)).cast("int")
        first = at - at % arity
        left = F.substr(level, first * DIGITS + 1, (at - first) * DIGITS)
        right = F.substr(level, (at + 1) * DIGITS + 1, (first + arity - 1 - at) * DIGITS)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), depth), beside)


def _blocks(nodes: DataFrame, arity: int) -> DataFrame:
    """Blocks of ``nodes`` (group, place, size, digest, kept) with all their levels."""
    held = arity**LEVELS
    member = F.struct("place", "digest", "kept")
    blocks = nodes.groupBy("group", F.expr(f"place div {held}").alias("block")).agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.max("size").alias("size")
    )
    depth = _depth(F.col("size"), arity)
    first = F.array_join(F.col("members")["digest"], "").cast("binary")
    # An accumulator is a value: a level is hashed once, however often its substrings are asked for.
    levels = F.aggregate(
        F.array_repeat(F.lit(0), depth),
        F.array(first),
        lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1), arity))),
    )
    return blocks.select("group", "block", "members", "size", depth.alias("depth"), levels.alias("levels"))


def _tree(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks, round by round, and each group's root."""
    held, largest = arity**LEVELS, nodes.agg(F.max("size")).first()[0] or 1
    rounds = []
    while True:
        rounds.append(saved(_blocks(nodes, arity), "blocks"))
        nodes = rounds[-1].select(
            "group",
            F.col("block").alias("place"),
            F.expr(f"(size + {held - 1}) div {held}").alias("size"),
            F.element_at("levels", -1).cast("string").alias("digest"),
            F.lit(None).cast("int").alias("kept"),
        )
        largest = -(-largest // held)
        if largest == 1:
            return rounds, nodes.select("group", "digest")


def _paths(rounds: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Each node's whole path (group, place, digest, kept, path, and other columns of ``tops``).

    ``tops`` has a group's own path to the root of all.
    """
    others = [c for c in tops.columns if c not in ("group", "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        place = lambda m: (m["place"] % arity**LEVELS).cast("int")
        own = lambda m: _siblings(F.col("levels"), F.col("depth"), place(m), arity)
        member = lambda m: F.struct(m.alias("m"), F.concat(own(m), F.col("path")).alias("path"))
        found = blocks.join(above, ["group", "block"]).select("group", *others, F.explode(F.transform("members", member)).alias("x"))
        nodes = found.select("group", *others, "x.m.place", "x.m.digest", "x.m.kept", "x.path")
        above = nodes.select("group", *others, F.col("place").alias("block"), "path")
    return nodes


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    folded = F.aggregate(path, digest.cast("binary"), lambda own, s: node(s["left"], own, s["right"]).cast("binary"))
    return folded.cast("string")


def siblings(path: Column) -> Column:
    """All siblings of a path in their order, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"].cast("string"), s["right"].cast("string"))), "")


def manifest(
    rows: DataFrame, group: str, order: str, leaf: Column, claimed: Column | None = None, keep: tuple[str, ...] = (), arity: int = 2
) -> Manifest:
    """The tree of ``rows``: leaves by ``order`` within ``group``, groups in the order of their text, null first.

    ``leaf`` is a row's node, ``claimed`` another one that someone may claim for it (null: none);
    ``keep`` names columns to carry. Rows of one group and order go by leaf, so that repeated rows
    have one result; null orders come first. A lone node is its own root; a table without rows has
    no root and gives none. Other columns are not read, so their names do not matter.
    """
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    claimed = F.lit(None).cast("string") if claimed is None else claimed
    kept = F.struct(F.struct(*(F.col(c) for c in keep or (order,))).alias("row"), claimed.alias("claimed"))
    # Texts are read and hashed once: sorting by ranges would read its input twice.
    leaves = saved(rows.select(key.alias("group"), F.col(order).alias("by"), leaf.alias("digest"), kept.alias("kept")), "leaves")
    rounds, subroots = _tree(numbered(leaves, "group", "by", "digest"), arity)
    tops = subroots.select(F.lit("").alias("group"), "digest", F.col("group").alias("kept"))
    upper, root = _tree(numbered(tops, "group", "kept"), arity)
    start = root.select("group", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("path"))
    of_group = _paths(upper, start, arity).select(F.col("kept").alias("group"), F.col("digest").alias("subroot"), "root", "path")
    found = _paths(rounds, of_group, arity)
    return Manifest(found.select("kept.row", F.col("digest").alias("leaf"), "kept.claimed", "subroot", "root", "path"))
