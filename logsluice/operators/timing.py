"""Questions about time: request rate, requests in flight, gaps between requests.

Timestamps are ordered inside bounded slices (a second, a minute) and only slice
totals are carried across, so no task has to order more than one slice of
one key, however much of the log that key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_exceedance(requests: DataFrame, cap: int) -> DataFrame:
    """Seconds with more than ``cap`` requests, and by how many."""
    per_second = requests.groupBy(F.date_trunc("second", "ts").alias("second")).agg(
        F.count("*").alias("requests")
    )
    return per_second.where(F.col("requests") > cap).withColumn(
        "excess", F.col("requests") - F.lit(cap)
    )


def peak_in_flight(outcomes: DataFrame) -> DataFrame:
    """Most requests open at once in each minute that has a start or an end.

    A request is open from ``ts`` for ``latency_us``, end excluded. Starts and ends
    are netted per microsecond; then seconds and minutes are summarised in turn as
    (net change, highest level relative to the slice's start).
    """
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = F.array(
        F.struct(start.alias("at"), F.lit(1).cast("bigint").alias("delta")),
        F.struct((start + F.col("latency_us")).alias("at"), F.lit(-1).cast("bigint").alias("delta")),
    )
    instants = (
        outcomes.where((F.col("latency_us") > 0) & F.col("ts").isNotNull())
        .select(F.inline(edges))
        .groupBy("at")
        .agg(F.sum("delta").alias("net"))
        .withColumn("peak", F.col("net"))
    )
    return peak_of_seconds(_summarise(instants, F.expr("at div 1000000")))


def peak_of_seconds(seconds: DataFrame) -> DataFrame:
    """Peaks per minute from what each second (``at``) adds up to (``net``) and reaches above its start (``peak``)."""
    minutes = _summarise(seconds, F.expr("at div 60"))
    # One row per minute of the log, 525 600 a year, however many requests it has.
    level = _sum_before(Window.orderBy("at"))
    return minutes.withColumn("level", level).select(
        F.timestamp_seconds(F.col("at") * 60).alias("minute"),
        F.greatest(F.col("level"), F.col("level") + F.col("peak")).alias("peak"),
    )


def _summarise(steps: DataFrame, slice_of: Column) -> DataFrame:
    """Combine consecutive steps into slices, keeping net change and relative peak."""
    inside = Window.partitionBy("slice").orderBy("at")
    return (
        steps.withColumn("slice", slice_of)
        .withColumn("before", _sum_before(inside))
        .groupBy("slice")
        .agg(F.sum("net").alias("net"), F.max(F.col("before") + F.col("peak")).alias("peak"))
        .withColumnRenamed("slice", "at")
    )


def _sum_before(window) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("net").over(earlier), F.lit(0))


def replay_schedule(requests: DataFrame, key: str) -> DataFrame:
    """Gap to the previous request of the same ``key`` and offset from its first, in microseconds.

    A key's requests are first counted per instant; gaps are found between instants, ordered
    within one second of a key, with what earlier seconds hold carried over (one row per key
    and second, ordered within one day, then one row per key and day). Requests get their gap
    by an equi-join, whose large partitions Spark can split. Of the requests of one instant
    the one with the smallest ``line_no`` has the gap to the instant before, the others 0.
    Requests without a time have neither gap nor offset; those without a key are one group.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # A struct is never null and equals another with a null inside, so a plain
    # equi-join serves missing keys too.
    rows = requests.select("line_no", F.struct(key).alias("of"), at.alias("at"))
    timed = rows.where(F.col("at").isNotNull())
    instants = timed.groupBy("of", "at").agg(F.min("line_no").alias("first_line"))
    seconds = _carried(_spans(instants.withColumn("low", F.col("at")).withColumn("high", F.col("at")), "at div 1000000"))
    in_second = Window.partitionBy("of", "span").orderBy("at")
    placed = instants.withColumn("span", F.expr("at div 1000000")).join(seconds, ["of", "span"])
    previous = F.coalesce(F.lag("at").over(in_second), "before_span")
    placed = placed.select("of", "at", "first_line", "first_at", previous.alias("previous"))
    scheduled = timed.join(placed, ["of", "at"]).select(
        "line_no",
        f"of.{key}",
        F.when(F.col("line_no") == F.col("first_line"), F.col("at") - F.col("previous")).otherwise(0).alias("gap_us"),
        (F.col("at") - F.col("first_at")).alias("offset_us"),
    )
    unknown = F.lit(None).cast("bigint")
    untimed = rows.where(F.col("at").isNull()).select(
        "line_no", f"of.{key}", unknown.alias("gap_us"), unknown.alias("offset_us")
    )
    return scheduled.unionByName(untimed)


def schedule_of_seconds(seconds: DataFrame, key: str) -> DataFrame:
    """Like ``replay_schedule``, from the sorted ``requests`` (``at``, ``line_no``) of each second of a key.

    ``seconds`` has ``of`` (the key in a struct), ``span`` (null: requests without a time) and ``requests``.
    Only one row per second is shuffled to find what earlier seconds hold; requests stay in their second.
    """
    timed = seconds.where("span IS NOT NULL")
    at = F.col("requests")["at"]
    bounds = timed.select("of", "span", at[0].alias("low"), F.element_at(at, -1).alias("high"))
    placed = timed.join(_carried(bounds), ["of", "span"])

    def scheduled(request: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(at, i - 1)).otherwise(F.col("before_span"))
        gap, offset = request["at"] - before, request["at"] - F.col("first_at")
        return F.struct(request["line_no"].alias("line_no"), gap.alias("gap_us"), offset.alias("offset_us"))

    rows = placed.select(f"of.{key}", F.explode(F.transform("requests", scheduled)).alias("r"))
    unknown = F.lit(None).cast("bigint")
    untimed = seconds.where("span IS NULL").select(f"of.{key}", F.explode("requests").alias("r"))
    return rows.select("r.line_no", key, "r.gap_us", "r.offset_us").unionByName(
        untimed.select("r.line_no", key, unknown.alias("gap_us"), unknown.alias("offset_us"))
    )


def _carried(seconds: DataFrame) -> DataFrame:
    """With each second of a key its ``before_span``, the latest time before it, and the key's ``first_at``."""
    days = _spans(seconds, "span div 86400").withColumnRenamed("span", "day")
    over_key = Window.partitionBy("of").orderBy("day")
    days = days.select(
        "of", "day", F.lag("high").over(over_key).alias("before_day"), F.min("low").over(over_key).alias("first_at")
    )
    in_day = Window.partitionBy("of", "day").orderBy("span")
    seconds = seconds.withColumn("day", F.expr("span div 86400")).join(days, ["of", "day"])
    return seconds.select(
        "of", "span", "first_at", F.coalesce(F.lag("high").over(in_day), "before_day").alias("before_span")
    )


def _spans(parts: DataFrame, span: str) -> DataFrame:
    """Earliest and latest time per key and ``span``, an expression over ``parts``."""
    return parts.groupBy("of", F.expr(span).alias("span")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
