"""Streams of requests and outcomes as seconds that are stored once, for questions about time.

A second is held until the watermark has passed it, then stored with what it adds up to; rows that
come later are dropped, as with every watermark. What goes from one second to the next is carried when
the stored seconds are read, by the same steps as in batch jobs. State is the seconds within the
watermark's delay; a busy key is as many groups as it has seconds. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsluice.streaming.jobs import start_parquet


def start_seconds_in_flight(outcomes: DataFrame, path: str, checkpoint: str, delay: str, **trigger) -> StreamingQuery:
    """Store, for each second with a start or an end, the net change and the highest level above its start.

    ``operators.timing.peak_of_seconds`` makes peaks per minute of what is stored. Starts and ends have
    watermarks of their own, of which the slower counts: an end far ahead makes no start late.
    """
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    open_ones = outcomes.where((F.col("latency_us") > 0) & F.col("ts").isNotNull())

    def edges(at: Column, delta: int) -> DataFrame:
        rows = open_ones.select(F.timestamp_micros(at).alias("edge_ts"), at.alias("at"), F.lit(delta).cast("bigint").alias("delta"))
        return rows.withWatermark("edge_ts", delay)

    both = edges(start, 1).unionByName(edges(start + F.col("latency_us"), -1))
    listed = F.array_sort(F.collect_list(F.struct("at", "delta")))
    seconds = both.groupBy(F.window("edge_ts", "1 second").alias("second")).agg(_levels(listed).alias("levels"))
    stored = seconds.select(F.unix_seconds("second.start").alias("at"), "levels.net", "levels.peak")
    return start_parquet(stored, path, checkpoint, trigger)


def _levels(edges: Column) -> Column:
    """The sum of sorted edges and the highest sum behind an instant; edges of one instant count together."""
    none = F.lit(None).cast("bigint")
    begin = F.struct(F.lit(0).cast("bigint").alias("level"), none.alias("peak"), none.alias("at"))

    def step(seen: Column, edge: Column) -> Column:
        left_behind = F.when(seen["at"] != edge["at"], seen["level"])
        return F.struct(
            (seen["level"] + edge["delta"]).alias("level"),
            F.greatest(seen["peak"], left_behind).alias("peak"),
            edge["at"].alias("at"),
        )

    def end(seen: Column) -> Column:
        return F.struct(seen["level"].alias("net"), F.greatest(seen["peak"], seen["level"]).alias("peak"))

    return F.aggregate(edges, begin, step, end)


def start_request_seconds(requests: DataFrame, key: str, path: str, checkpoint: str, delay: str, **trigger) -> StreamingQuery:
    """Store the requests of each second of a ``key``, sorted; ``operators.timing.schedule_of_seconds`` reads them.

    Requests without a time belong to no second and are stored at once; those without a key are one key.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = requests.select("ts", F.struct(key).alias("of"), F.struct(at.alias("at"), "line_no").alias("request"))
    timed = rows.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    seconds = timed.groupBy("of", F.window("ts", "1 second").alias("second")).agg(
        F.array_sort(F.collect_list("request")).alias("requests")
    )
    stored = seconds.select("of", F.unix_seconds("second.start").alias("span"), "requests")
    untimed = rows.where(F.col("ts").isNull()).select("of", F.lit(None).cast("bigint").alias("span"), F.array("request").alias("requests"))
    return start_parquet(stored.unionByName(untimed), path, checkpoint, trigger)
