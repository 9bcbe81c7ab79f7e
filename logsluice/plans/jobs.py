"""Batch jobs from lines to requests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.decode import utc_timestamp
from logsluice.operators.classify import classify_lines
from logsluice.operators.dispatch import dry_run, has_valid_method, invalid_method_outcomes
from logsluice.operators.filters import with_passes
from logsluice.operators.limit import limit_lines, limit_source, numbered_limit
from logsluice.operators.sanitize import sanitize, sanitize_error, sendable
from logsluice.operators.stats import full_report, ingest_funnel, stats_report
from logsluice.options import JobOptions
from logsluice.sources.lines import numbered_lines
from logsluice.sources.unreadable import find_unreadable, unreadable_table


def judged_lines(lines: DataFrame, options: JobOptions, where: Column | None = None) -> DataFrame:
    """Classified lines with ``ts``, ``passes`` and ``sanitize_error``; ``where`` selects lines before decoding."""
    passed = with_passes(classify_lines(lines, where), options)
    error = F.when(F.col("passes"), sanitize_error())
    times = passed.withColumn("ts", utc_timestamp("timestamp")) if "ts" not in lines.columns else passed
    return times.withColumn("sanitize_error", error)


def source_lines(spark: SparkSession, options: JobOptions) -> DataFrame:
    """Lines of the configured source, cut at ``max_records``."""
    return limit_source(spark, options)


def numbered_source(spark: SparkSession, options: JobOptions) -> DataFrame:
    """Like ``source_lines``, with numbers that come from the files alone: outcomes stored today join tomorrow."""
    return numbered_limit(numbered_lines(spark, options.require_source(), options.region), options)


def surviving_source(spark: SparkSession, options: JobOptions) -> tuple[DataFrame, DataFrame]:
    """Lines of a source of which some files cannot be read, cut at ``max_records``, and these files with their errors.

    The lines before a fault are kept, and the fault itself is one line that counts as an ``io_error``.
    """
    unreadable = find_unreadable(spark, options.require_source(), options.region)
    return limit_source(spark, options, sorted(unreadable)), unreadable_table(spark, unreadable)


def funnel(lines: DataFrame, options: JobOptions, where: Column | None = None) -> DataFrame:
    """What became of every line, as one row of counters."""
    return ingest_funnel(judged_lines(lines, options, where))


def limited_funnel(lines: DataFrame, options: JobOptions) -> DataFrame:
    """The funnel over lines with an integer ``line_no``, cut at ``max_records``."""
    return funnel(limit_lines(lines, options), options)


def sanitized_requests(lines: DataFrame, options: JobOptions, where: Column | None = None) -> DataFrame:
    """Requests ready to send, from the lines that pass."""
    passed = judged_lines(lines, options, where).where("passes and sanitize_error is null")
    keys = ["value", "line_class", "passes", "sanitize_error"]
    return sendable(sanitize(passed.drop(*keys), options))


def dry_run_report(lines: DataFrame, options: JobOptions) -> DataFrame:
    """Report of a run that sends nothing, from a single aggregation over the lines.

    Dry-run outcomes count as attempted and succeeded and nothing else, so the
    line counters already hold them; log time stands in for the run's clock.
    """
    judged = judged_lines(lines, options).withColumn(
        "sent", F.col("passes") & F.col("sanitize_error").isNull()
    )
    when_sent = F.when(F.col("sent"), F.col("ts"))
    counts = judged.agg(
        F.count("*").alias("total_lines"),
        F.count_if(
            F.col("line_class").isin("io_error", "json_error") | F.col("sanitize_error").isNotNull()
        ).alias("parse_errors"),
        F.count_if((F.col("line_class") == "record") & ~F.col("passes")).alias("filtered_count"),
        F.count_if("sent").alias("attempted"),
        (F.unix_micros(F.max(when_sent)) - F.unix_micros(F.min(when_sent))).alias("_span"),
    )
    elapsed = F.coalesce(F.col("_span") / F.lit(1e6), F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    return counts.select(
        "total_lines",
        "parse_errors",
        "filtered_count",
        "attempted",
        F.col("attempted").alias("succeeded"),
        zero.alias("failed"),
        F.create_map().cast("map<int,bigint>").alias("status_distribution"),
        F.create_map().cast("map<string,bigint>").alias("error_categories"),
        elapsed.alias("elapsed_secs"),
        F.when(elapsed > 0, F.col("attempted") / elapsed).otherwise(F.lit(0.0)).alias("throughput_rps"),
        zero.alias("p50_us"),
        zero.alias("p95_us"),
        zero.alias("p99_us"),
    )


def dry_run_outcomes(lines: DataFrame, options: JobOptions) -> DataFrame:
    return dry_run(sanitized_requests(lines, options))


def replay_report(lines: DataFrame, outcomes: DataFrame, options: JobOptions) -> DataFrame:
    """Line counters joined with the statistics of outcomes produced by a sender."""
    return full_report(funnel(lines, options), stats_report(outcomes))


def known_failures(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into those worth sending and outcomes of those with a bad method."""
    return requests.where(has_valid_method()), invalid_method_outcomes(requests)
