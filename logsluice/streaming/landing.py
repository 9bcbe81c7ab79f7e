"""Streams stored with the batch each row came in, and what can be told from that.

A batch is named by its time, which Spark logs before it runs the batch and reads back when it
runs it again; files of a batch that was already stored are not stored twice. So all that
depends on the order of batches (a limit, a watermark, a running report) is a function of what is
stored: it is the same after a restart, however often a batch was tried. The clock of the driver must not go back
between runs of one stream.
"""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsluice.operators.compare import found_in
from logsluice.operators.stats import cell_columns, outcome_report, tally
from logsluice.options import JobOptions
from logsluice.streaming.jobs import REQUEST, SANITIZE_ERROR, disposed_lines, start_parquet

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = "was_dry_run boolean, status int, category string, bucket long, n long, first_ts timestamp, last_ts timestamp"
# Cells that a task holds before it merges them.
HELD = 1 << 16


def with_batch(rows: DataFrame) -> DataFrame:
    """The rows of a stream with the time of their batch: one value per batch, the same when it runs again."""
    return rows.withColumn("batch", F.current_timestamp())


# --- a limit ---------------------------------------------------------------------------------


def start_ordered_request_stream(lines: DataFrame, options: JobOptions, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Like ``streaming.jobs.start_request_stream``, in one table that keeps the order of lines; not limited."""
    disposed = disposed_lines(lines, dataclasses.replace(options, max_records=None))
    return start_parquet(with_batch(disposed), path, checkpoint, trigger)


def _passed() -> Column:
    return F.col("disposition").isin(REQUEST, SANITIZE_ERROR)


def limited_lines(spark: SparkSession, path: str, max_records: int) -> DataFrame:
    """What ``start_ordered_request_stream`` stored, up to the line with the last wanted record.

    Lines count by batch, then file, then place in the file. Passing lines are counted per split
    of a file; within the split of the last one, its place is looked up. Two rows reach the driver.
    """
    stored = spark.read.parquet(path)
    if max_records == 0:
        return stored.where(F.lit(False))
    split = F.struct(F.unix_micros("batch").alias("batch"), F.col("line_no.file").alias("file"), F.col("line_no.block").alias("block"))
    # A task writes the lines of a split one after the other.
    place = F.struct(F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("at"))
    rows = stored.select("*", split.alias("_split"), place.alias("_place"))
    counts = rows.where(_passed()).groupBy("_split").agg(F.count("*").alias("n"))
    seen = F.sum("n").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = counts.withColumn("seen", seen).where(F.col("seen") >= max_records).orderBy("seen").first()
    if hit is None:
        return stored
    last_split = F.struct(*(F.lit(hit["_split"][name]).alias(name) for name in ("batch", "file", "block")))
    inside = rows.where(_passed() & (F.col("_split") == last_split)).select("_place")
    upto = inside.orderBy("_place").limit(max_records - (hit["seen"] - hit["n"])).agg(F.max("_place").alias("last")).first()["last"]
    last_place = F.struct(F.lit(upto["part"]).alias("part"), F.lit(upto["at"]).alias("at"))
    kept = (F.col("_split") < last_split) | ((F.col("_split") == last_split) & (F.col("_place") <= last_place))
    return rows.where(kept).drop("_split", "_place")


def run_limited_request_stream(
    spark: SparkSession, lines: DataFrame, options: JobOptions, path: str, checkpoint: str, poll: float = 0.2, **trigger
) -> bool:
    """Store lines until ``max_records`` of them have passed, or the stream ends; whether they have.

    The stream stops after the batch with the last wanted record, and does not start again for a
    limit that was reached before. What that batch holds too much is cut by ``limited_lines``.
    """
    wanted = options.max_records
    if wanted is None:
        raise ValueError("give max_records, or use start_ordered_request_stream")

    def reached() -> bool:
        try:
            return spark.read.parquet(path).where(_passed()).limit(wanted).count() >= wanted
        except AnalysisException:
            return wanted == 0

    if reached():
        return True
    query, batch = start_ordered_request_stream(lines, options, path, checkpoint, **trigger), None
    while not query.awaitTermination(poll):
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != batch:
            batch = progress["batchId"]
            if reached():
                query.stop()
                break
    return reached()


# --- late rows -------------------------------------------------------------------------------


def start_landing(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store every row of a stream with its batch."""
    return start_parquet(with_batch(rows), path, checkpoint, trigger)


def judged_arrivals(landed: DataFrame, window: str, delay: str) -> DataFrame:
    """Landed rows with their ``window``, the ``watermark`` of their batch and a ``verdict``.

    The watermark of a batch is ``delay`` before the latest ``ts`` of all earlier ones; a row is
    ``late`` if its window ends by then, ``untimed`` without a ``ts``, else ``on_time``. Each row has one
    verdict, whenever it is asked for. One row per batch is held at once.
    """
    latest = landed.groupBy("batch").agg(F.max("ts").alias("latest"))
    earlier = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    marks = latest.select("batch", (F.max("latest").over(earlier) - F.expr(f"INTERVAL {delay}")).alias("watermark"))
    # ``window`` would leave rows without a time out.
    timed = landed.where("ts IS NOT NULL").withColumn("window", F.window("ts", window))
    none = F.lit(None).cast(timed.schema["window"].dataType)
    rows = timed.unionByName(landed.where("ts IS NULL").withColumn("window", none))
    late = F.col("window.end") <= F.col("watermark")
    verdict = F.when(F.col("ts").isNull(), "untimed").when(late, "late").otherwise("on_time")
    return rows.join(marks, "batch").withColumn("verdict", verdict)


# --- a running report ------------------------------------------------------------------------


def start_running_cells(outcomes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store the outcome counts of every batch, added up in each task; no state, and no row is too late."""
    rows = outcomes.select(*cell_columns(), F.lit(1).cast("long").alias("n"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    return start_parquet(with_batch(rows.mapInArrow(_merged, CELLS)), path, checkpoint, trigger)


def running_report(cells: DataFrame) -> DataFrame:
    """Statistics of all batches stored so far: the cells of batches add up."""
    return outcome_report(tally(cells))


def compact_cells(cells: DataFrame, path: str) -> None:
    """Store the sum of all cells, one row per distinct one; ``running_report`` reads it like the cells."""
    keys = ("was_dry_run", "status", "category", "bucket")
    sums = (F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("batch").alias("batch"))
    cells.groupBy(*keys).agg(*sums).write.mode("overwrite").parquet(path)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > HELD:
            held = _added(held)
            rows = sum(b.num_rows for b in held)
    yield from _added(held)


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not batches:
        return []
    nullable = pa.schema([(f.name, f.type) for f in batches[0].schema])
    table = pa.concat_tables(pa.Table.from_arrays(b.columns, schema=nullable) for b in batches)
    keys = table.column_names[:4]
    sums = table.group_by(keys).aggregate([("n", "sum"), ("first_ts", "min"), ("last_ts", "max")])
    return sums.select([*keys, "n_sum", "first_ts_min", "last_ts_max"]).rename_columns(table.column_names).combine_chunks().to_batches()


# --- recorded against replayed ---------------------------------------------------------------


def start_status_pairs(
    recorded: DataFrame, replayed: DataFrame, path: str, checkpoint: str, within: str, watermark: str, **trigger
) -> StreamingQuery:
    """Store pairs of recorded and replayed requests (``line_no``, ``ts``, ``status``) as both streams go on.

    An outcome belongs to the request of its ``line_no`` if its ``ts`` lies ``within`` after the request's.
    Rows that meet no other are stored alone once the watermarks of both sides say that none can come;
    only rows younger than that are held. Rows without ``ts`` or ``line_no`` meet no other.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            F.col("line_no").alias(f"{name}_no"),
            F.col("ts").alias(f"{name}_ts"),
            F.col("status").alias(f"{name}_status"),
            F.lit(True).alias(f"was_{name}"),
        )

    left, right = side(recorded, "recorded"), side(replayed, "replayed")
    met = left.where("recorded_ts IS NOT NULL").withWatermark("recorded_ts", watermark).join(
        right.where("replayed_ts IS NOT NULL").withWatermark("replayed_ts", watermark),
        F.expr(f"recorded_no = replayed_no AND replayed_ts BETWEEN recorded_ts AND recorded_ts + INTERVAL {within}"),
        "full",
    )
    pairs = met
    for rows in (left.where("recorded_ts IS NULL"), right.where("replayed_ts IS NULL")):
        pairs = pairs.unionByName(rows, allowMissingColumns=True)
    return start_parquet(pairs.withColumn("found_in", found_in()).drop("was_recorded", "was_replayed"), path, checkpoint, trigger)
