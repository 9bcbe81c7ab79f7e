"""Writers for reports, requests and rejects."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.operators.stats import REPORT_COLUMNS
from logsluice.sources.outcomes import as_outcomes

log = logging.getLogger(__name__)

# Headings, labels and number formats of the text summary.
HEADING = "Run complete — Summary:"
INTERRUPTED_HEADING = "[INTERRUPTED] Partial run summary:"
COUNTER_LABELS = (
    ("Lines read", "total_lines", "%d"),
    ("Parse errors", "parse_errors", "%d"),
    ("Filtered", "filtered_count", "%d"),
    ("Attempted", "attempted", "%d"),
    ("Succeeded (2xx)", "succeeded", "%d"),
    ("Failed", "failed", "%d"),
    ("Elapsed", "elapsed_secs", "%.2fs"),
    ("Throughput", "throughput_rps", "%.1f req/s"),
)
LATENCY_LABELS = (("p50", "p50_us", "%d"), ("p95", "p95_us", "%d"), ("p99", "p99_us", "%d"))
LATENCY_SECTION = "Latency (µs)"
STATUS_SECTION = "Status distribution"
ERROR_SECTION = "Error categories"


def write_stats_json(report: DataFrame, path: str) -> bool:
    """Replace ``path`` by the report as JSON; a failure is logged, not raised."""
    try:
        as_json = F.to_json(F.struct(*REPORT_COLUMNS), {"pretty": "true", "ignoreNullFields": "false"})
        report.select(as_json.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    except Exception:
        log.exception("could not write statistics to %s", path)
        return False
    return True


def summary_lines(report: DataFrame, interrupted: bool = False) -> DataFrame:
    """The text summary of a one-row report as ``ord, section, label, value``.

    Statuses and categories come in ascending order; their sections are absent
    when there is nothing to show.
    """
    heading = INTERRUPTED_HEADING if interrupted else HEADING
    fixed = [_line(heading, label, F.format_string(f, c)) for label, c, f in COUNTER_LABELS]
    fixed += [_line(LATENCY_SECTION, label, F.format_string(f, c)) for label, c, f in LATENCY_LABELS]
    lines = F.concat(
        F.array(*fixed),
        _distribution(STATUS_SECTION, "status_distribution"),
        _distribution(ERROR_SECTION, "error_categories"),
    )
    numbered = report.select(F.posexplode(lines).alias("ord", "line"))
    return numbered.select("ord", "line.section", "line.label", "line.value")


def write_requests(requests: DataFrame, path: str, mode: str = "errorifexists", max_rows: int = 1_000_000) -> None:
    """Store requests by log date in UTC, in files of at most ``max_rows``.

    ``mode="overwrite"`` replaces the dates that ``requests`` has and leaves all others as they are, so a
    job over some days may run again. Rows without a date are one such part, too.

    Rows stay in the tasks that read them: logs are roughly in time order, so each
    task holds few dates and no date has to pass through one task.
    """
    micros, day = F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000
    days = (micros - F.pmod(micros, F.lit(day))) / F.lit(day)
    dated = requests.withColumn("date", F.date_from_unix_date(days.cast("int")))
    writer = dated.write.mode(mode).option("maxRecordsPerFile", max_rows).partitionBy("date")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_rejects(rejects: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store lines that could not be read or decoded, by class."""
    rejects.write.mode(mode).partitionBy("line_class").parquet(path)


def _line(section: str, label: str | Column, value: Column) -> Column:
    text = F.lit(label) if isinstance(label, str) else label
    return F.struct(F.lit(section).alias("section"), text.alias("label"), value.alias("value"))


def _distribution(section: str, counts: str) -> Column:
    entries = F.array_sort(F.map_entries(counts))
    return F.transform(
        entries, lambda e: _line(section, e["key"].cast("string"), e["value"].cast("string"))
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Store lines with their ``line_no``.

    Spark numbers lines of files anew whenever it cuts splits otherwise. Jobs over stored
    lines all see the same ``line_no``, so what they write can be joined later.
    """
    lines.withColumn("value", F.col("value").cast("binary")).write.parquet(path)


def read_stored_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("string"))


def write_outcomes(outcomes: DataFrame, path: str, *keys: str) -> None:
    """Store outcomes with ``keys``, such as the ``line_no`` of their requests."""
    as_outcomes(outcomes, *keys).write.parquet(path)
