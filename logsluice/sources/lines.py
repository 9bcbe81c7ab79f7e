"""NDJSON text lines from any file system Spark can read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsluice.options import JobOptions

# Splits whose line counts may go to every task: some ten bytes each and their file's name.
BROADCAST_SPLITS = 200_000


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    region: str | None = None,
    after: str | None = None,
    upto: str | None = None,
    only: Sequence[str] | None = None,
    without: Sequence[str] = (),
    ignore_corrupt: bool = False,
) -> DataFrame:
    """Lines as ``line_no struct<file, block, row>`` and ``value``.

    ``path`` is taken as it is, not as a pattern; a file or folder that Spark would hide is refused.

    Sorting by ``line_no`` restores file order: Spark may hand out splits in any
    order, but a split's rows keep theirs. ``after`` (exclusive), ``upto`` (inclusive), ``only``
    and ``without`` select files by name; the others are not opened. With ``ignore_corrupt``, a file that
    cannot be read to its end ends there in silence.
    """
    return _numbered(_files(spark, path, region, after, upto, only, without, ignore_corrupt), F.monotonically_increasing_id())


def _files(spark, path, region=None, after=None, upto=None, only=None, without=(), ignore_corrupt=False) -> DataFrame:
    reader = _reader(spark, region)
    text = (reader.option("ignoreCorruptFiles", "true") if ignore_corrupt else reader).text(literal_path(path))
    file = F.col("_metadata.file_path")
    if after is not None:
        text = text.where(file > after)
    if upto is not None:
        text = text.where(file <= upto)
    if only is not None:
        text = text.where(file.isin(list(only)))
    if without:
        text = text.where(~file.isin(list(without)))
    return text


def split_lines(
    spark: SparkSession, path: str | list[str], region: str | None = None, after=None, upto=None, ignore_corrupt: bool = False
) -> DataFrame:
    """Lines as ``line_no``, ``value`` and the ``length`` of their split, which starts at ``line_no.block``."""
    text = _files(spark, path, region, after, upto, ignore_corrupt=ignore_corrupt)
    return _numbered(text, F.monotonically_increasing_id(), F.col("_metadata.file_block_length").alias("length"))


def numbered_lines(spark: SparkSession, path: str | list[str], region: str | None = None) -> DataFrame:
    """Lines as ``line_no struct<file, row>``, the number of the line in its file from 0, and ``value``.

    The number depends on the file alone: it is the same for any size of splits and number of
    cores, today and when the file is read again, so what was stored by it can be joined later.
    Files are read twice. Filters on the result do not reach the list of files, which would cut other splits.
    """
    lines = read_lines(spark, path, region)
    placed = with_place(lines, few_splits=_most_splits(lines) <= BROADCAST_SPLITS)
    return placed.select(F.struct("line_no.file", F.col("place").alias("row")).alias("line_no"), "value")


def with_place(lines: DataFrame, few_splits: bool) -> DataFrame:
    """Lines as ``read_lines`` makes them with their ``place`` in their file, from 0.

    Lines are counted per split, and a split's lines go on from what its file has before it; nothing is
    sorted or shuffled but one row per split. These rows go to every task if there are ``few_splits``.
    """
    at = F.col("line_no")
    splits = lines.groupBy(at["file"].alias("of_file"), at["block"].alias("of_block")).agg(
        F.min(at["row"]).alias("first"), F.count("*").alias("n")
    )
    before = F.sum("n").over(Window.partitionBy("of_file").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("of_file", "of_block", "first", "n", F.coalesce(before, F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if few_splits else starts
    found = lines.join(starts, (at["file"] == F.col("of_file")) & (at["block"] == F.col("of_block")), "left")
    inside = at["row"] - F.col("first")
    # Both sides are planned together and see the same splits; were they to differ, no number would be right.
    place = F.when((inside >= 0) & (inside < F.col("n")), F.col("before") + inside).otherwise(
        F.raise_error(F.lit("the splits of the files changed while they were read")).cast("long")
    )
    return found.select(*lines.columns, place.alias("place"))


def _most_splits(lines: DataFrame) -> int:
    """Splits that the files can have, from their number and the planner's size."""
    spark = lines.sparkSession
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    widest = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return len(lines.inputFiles()) + max(size // widest, 2 * spark.sparkContext.defaultParallelism)


def list_files(spark: SparkSession, path: str | list[str], region: str | None = None) -> list[str]:
    """Input files in the order their lines count; listing only, nothing is read."""
    names = _reader(spark, region).text(literal_path(path)).inputFiles()
    # The listing writes an empty authority, file:///a, which line_no.file does not.
    return sorted(name.replace(":///", ":/", 1) for name in names)


def literal_path(path: str | list[str]) -> str | list[str]:
    """``path`` with the characters of patterns escaped; raises for names that Spark skips in silence."""
    if not isinstance(path, str):
        return [literal_path(p) for p in path]
    name = path.rstrip("/").rpartition("/")[2]
    if name.startswith((".", "_")) and name not in (".", ".."):
        raise ValueError(f"Spark does not read files whose names start with . or _: {path}")
    return re.sub(r"([\\\[\]{}*?^])", r"\\\1", path)


def _reader(spark: SparkSession, region: str | None):
    reader = spark.read.option("lineSep", "\n")
    return reader.option("fs.s3a.endpoint.region", region) if region else reader


def read_source(spark: SparkSession, options: JobOptions) -> DataFrame:
    """Lines of the one source that ``options`` names."""
    return read_lines(spark, options.require_source(), options.region)


def stream_lines(
    spark: SparkSession,
    path: str,
    region: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Lines of files as they arrive.

    A stream has no order of rows: ``row`` is a random number, which tells lines apart once
    they are stored, but is another one when the files are read again.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if region:
        reader = reader.option("fs.s3a.endpoint.region", region)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _numbered(reader.text(literal_path(path)), F.xxhash64(F.uuid()))


def _numbered(text: DataFrame, row: Column, *more: Column) -> DataFrame:
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        row.alias("row"),
    )
    return text.select(position.alias("line_no"), _without_carriage_return("value").alias("value"), *more)


def _without_carriage_return(name: str) -> Column:
    value = F.col(name)
    return F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)
