"""Counts, distributions and latency percentiles of outcomes.

One scan and one linear plan: outcomes are first counted per distinct combination
of flags, status, error category and latency bucket (partial aggregation on the
map side), and everything else is derived from those few rows. The cells are
additive, so batch jobs, streams and merged partial results share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.functions.outcomes import error_category, is_success, latency_bucket
from logsluice.schema import BLANK, IO_ERROR, JSON_ERROR

PERCENTILES = (("p50_us", 0.50), ("p95_us", 0.95), ("p99_us", 0.99))

REPORT_COLUMNS = (
    "total_lines",
    "parse_errors",
    "filtered_count",
    "attempted",
    "succeeded",
    "failed",
    "status_distribution",
    "error_categories",
    "elapsed_secs",
    "throughput_rps",
    "p50_us",
    "p95_us",
    "p99_us",
)


def ingest_funnel(lines: DataFrame) -> DataFrame:
    """One row of counters from lines with ``line_class``, ``passes`` and ``sanitize_error``."""
    kind, passes = F.col("line_class"), F.col("passes")
    bad = passes & F.col("sanitize_error").isNotNull()
    counts = lines.agg(
        F.count("*").alias("total_lines"),
        F.count_if(kind == IO_ERROR).alias("io_errors"),
        F.count_if(kind == BLANK).alias("blank_lines"),
        F.count_if(kind == JSON_ERROR).alias("json_errors"),
        F.count_if((kind == "record") & ~passes).alias("filtered_count"),
        F.count_if(passes).alias("dispatched"),
        F.count_if(bad).alias("sanitize_errors"),
    )
    parse_errors = F.col("io_errors") + F.col("json_errors") + F.col("sanitize_errors")
    return counts.withColumn("parse_errors", parse_errors)


def outcome_cells(outcomes: DataFrame, *group: str | Column) -> DataFrame:
    """Outcome counts per distinct combination, optionally per ``group``.

    Works on batch and, with a window among ``group``, on streaming outcomes.
    """
    return outcomes.groupBy(*group, *cell_columns()).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def cell_columns() -> list[Column]:
    """What tells the cells of outcomes apart."""
    dry = F.coalesce("was_dry_run", F.lit(False))
    live = ~dry
    return [
        dry.alias("was_dry_run"),
        F.when(live, F.col("status")).alias("status"),
        F.when(live, error_category(F.col("error"))).alias("category"),
        F.when(live, latency_bucket(F.col("latency_us"))).alias("bucket"),
    ]


def tally(cells: DataFrame, *group: str) -> DataFrame:
    """Cells as counts per ``kind`` (result, status, error, latency) and ``key`` or ``label``."""
    result = (
        F.when(F.col("was_dry_run"), "dry_run")
        .when(is_success(F.col("status")), "succeeded")
        .otherwise("failed")
    )
    measures = F.array(
        _measure("result", label=result),
        _measure("status", key=F.col("status")),
        _measure("error", label=F.col("category")),
        _measure("latency", key=F.col("bucket")),
    )
    known = F.filter(measures, lambda m: m["key"].isNotNull() | m["label"].isNotNull())
    return (
        cells.select(*group, F.explode(known).alias("m"), "n", "first_ts", "last_ts")
        .groupBy(*group, "m.kind", "m.key", "m.label")
        .agg(
            F.sum("n").alias("n"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )


def outcome_report(tallies: DataFrame, *group: str) -> DataFrame:
    """One row per group: counts, distributions as maps, elapsed time and percentiles."""
    by_key = Window.partitionBy(*group, "kind").orderBy("key")
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most one row per status, category and latency bucket in each window.
    ranked = tallies.withColumn("seen", F.sum("n").over(upto)).withColumn(
        "of", F.sum("n").over(everything)
    )
    kind, n = F.col("kind"), F.col("n")

    def count(*labels: str) -> Column:
        chosen = (kind == "result") & F.col("label").isin(*labels)
        return F.coalesce(F.sum(F.when(chosen, n)), F.lit(0))

    def distribution(of_kind: str, key: Column) -> Column:
        pairs = F.collect_list(F.when(kind == of_kind, F.struct(key.alias("key"), n.alias("n"))))
        return F.map_from_entries(F.array_sort(pairs))

    return (
        ranked.groupBy(*group)
        .agg(
            count("dry_run", "succeeded", "failed").alias("attempted"),
            count("dry_run", "succeeded").alias("succeeded"),
            count("failed").alias("failed"),
            distribution("status", F.col("key").cast("int")).alias("status_distribution"),
            distribution("error", F.col("label")).alias("error_categories"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            *(_percentile(q).alias(name) for name, q in PERCENTILES),
        )
        .withColumn("elapsed_secs", _elapsed_secs())
        .withColumn("throughput_rps", _throughput())
    )


def stats_report(outcomes: DataFrame, *group: str) -> DataFrame:
    """Outcome statistics, overall or per ``group``."""
    return outcome_report(tally(outcome_cells(outcomes, *group), *group), *group)


def full_report(funnel: DataFrame, report: DataFrame) -> DataFrame:
    """Line counters and outcome statistics side by side in one row."""
    both = funnel.unionByName(report, allowMissingColumns=True)
    return both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in REPORT_COLUMNS))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Attempted, succeeded and failed."""
    dry, success = F.coalesce("was_dry_run", F.lit(False)), is_success(F.col("status"))
    return outcomes.agg(
        F.count("*").alias("attempted"),
        F.count_if(dry | success).alias("succeeded"),
        F.count_if(~dry & ~success).alias("failed"),
    )


def status_distribution(outcomes: DataFrame) -> DataFrame:
    answered = outcomes.where(~F.coalesce("was_dry_run", F.lit(False)) & F.col("status").isNotNull())
    return answered.groupBy("status").agg(F.count("*").alias("n"))


def error_distribution(outcomes: DataFrame) -> DataFrame:
    failed = outcomes.where(~F.coalesce("was_dry_run", F.lit(False)) & F.col("error").isNotNull())
    return failed.groupBy(error_category(F.col("error")).alias("category")).agg(
        F.count("*").alias("n")
    )


def latency_histogram(outcomes: DataFrame, *group: str) -> DataFrame:
    """Recorded latencies per bucket; dry runs and zero latencies are not recorded."""
    recorded = outcomes.where(~F.coalesce("was_dry_run", F.lit(False)) & (F.col("latency_us") > 0))
    return recorded.groupBy(*group, latency_bucket(F.col("latency_us")).alias("bucket_us")).agg(
        F.count("*").alias("n")
    )


def histogram_percentiles(histogram: DataFrame, *group: str) -> DataFrame:
    """Percentiles of a latency histogram, overall or per ``group``; 0 when empty."""
    tallies = histogram.select(
        *group, F.lit("latency").alias("kind"), F.col("bucket_us").alias("key"), "n"
    )
    by_key = Window.partitionBy(*group, "kind").orderBy("key")
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = tallies.withColumn("seen", F.sum("n").over(upto)).withColumn(
        "of", F.sum("n").over(everything)
    )
    return ranked.groupBy(*group).agg(*(_percentile(q).alias(name) for name, q in PERCENTILES))


def _measure(kind: str, key: Column | None = None, label: Column | None = None) -> Column:
    absent = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (absent if key is None else key).cast("bigint").alias("key"),
        (absent if label is None else label).cast("string").alias("label"),
    )


def _percentile(quantile: float) -> Column:
    """Upper end of the first bucket that covers the quantile's rank."""
    rank = F.greatest(F.ceil(F.lit(quantile) * F.col("of").cast("double")), F.lit(1))
    reached = (F.col("kind") == "latency") & (F.col("seen") >= rank)
    return F.coalesce(F.min(F.when(reached, F.col("key"))), F.lit(0)).cast("bigint")


def _elapsed_secs() -> Column:
    micros = F.unix_micros("last_ts") - F.unix_micros("first_ts")
    return F.coalesce(micros / F.lit(1e6), F.lit(0.0))


def _throughput() -> Column:
    elapsed = F.col("elapsed_secs")
    return F.when(elapsed > 0, F.col("attempted") / elapsed).otherwise(F.lit(0.0))
