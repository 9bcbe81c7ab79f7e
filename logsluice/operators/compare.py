"""Recorded against replayed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_mismatch(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Count of every (recorded, replayed) status pair, joined on ``line_no``.

    ``found_in`` is ``both``, ``recorded`` (never replayed) or ``replayed`` (an outcome
    without a record); rows without ``line_no`` are of the latter two. ``matched`` is null
    unless both sides are there. ``line_no`` must be unique on each side.
    """
    left = recorded.select("line_no", F.col("status").alias("recorded_status"), F.lit(True).alias("was_recorded"))
    right = replayed.select("line_no", F.col("status").alias("replayed_status"), F.lit(True).alias("was_replayed"))
    return pair_counts(left.join(right, "line_no", "full").withColumn("found_in", found_in()))


def found_in() -> Column:
    """Where a row of a full join comes from, by ``was_recorded`` and ``was_replayed``."""
    return F.when(F.col("was_replayed").isNull(), "recorded").when(F.col("was_recorded").isNull(), "replayed").otherwise("both")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Rows with ``recorded_status``, ``replayed_status`` and ``found_in``, counted."""
    alike = F.col("recorded_status").eqNullSafe(F.col("replayed_status"))
    counts = pairs.groupBy("recorded_status", "replayed_status", "found_in").agg(F.count("*").alias("n"))
    return counts.withColumn("matched", F.when(F.col("found_in") == "both", alike))


def first_outcomes(outcomes: DataFrame, key: str = "line_no") -> DataFrame:
    """One outcome per request, the earliest that was delivered; those without ``key`` all stay.

    Outcomes of one time are ordered by their other columns. Each task keeps one row per key
    before anything is shuffled, so that an outcome delivered very often is not a burden.
    """
    rest = [c for c in outcomes.columns if c not in (key, "ts")]
    order = F.struct(F.col("ts").isNull().alias("untimed"), "ts", *rest)
    first = outcomes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    chosen = first.select(*(F.col(c) if c == key else F.col(f"first.{c}").alias(c) for c in outcomes.columns))
    return chosen.unionByName(outcomes.where(F.col(key).isNull()))


def first_outcomes_of_stream(outcomes: DataFrame, delay: str, key: str = "line_no") -> DataFrame:
    """The outcomes of a stream without those of a request that came ``delay`` of ``ts`` or less after its first.

    What a longer delay let through is left to ``first_outcomes`` on the stored rows. Outcomes without ``key`` all stay.
    """
    own = F.struct(key, F.when(F.col(key).isNull(), F.uuid()).alias("row"))
    unique = outcomes.withColumn("_key", own).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_key"])
    return unique.drop("_key")
