"""Stop reading once a number of records has passed the filters.

The limit changes every counter: lines after the one with the last wanted record
count nowhere. Sorting all passing lines to find that one would send up to N rows
through a single task, so its position is found from counts instead: one row per
file or range of positions, refined until one position is left. Only those few
numbers reach the driver. Positions are selected before lines are decoded.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsluice.operators.classify import classify_lines
from logsluice.operators.filters import with_passes
from logsluice.options import JobOptions
from logsluice.sources.lines import list_files, read_lines, read_source, split_lines, with_place
from logsluice.sources.unreadable import faults, surviving_lines

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Ranges counted per round; bounds the rows of the running total.
RANGES = 1 << 16
# Positions looked at first, at least, and how much wider each range is than the one before it.
FIRST, GROWTH = 4096, 8
# Lines and files looked at one after the other before any file is counted as a whole.
HEAD_LINES, HEAD_FILES = 4096, 16
# Bytes of lines that may come to the driver and become part of the plan.
HEAD_BYTES = 4 << 20


@dataclass(frozen=True)
class Cut:
    """The first ``lines`` lines of a file, which all lie in splits that start before ``end``."""

    lines: int
    end: int


@dataclass(frozen=True)
class Limit:
    """A cut in a file, behind all of the files up to ``previous`` (None: there are none)."""

    file: str
    previous: str | None
    cut: Cut


def limit_lines(lines: DataFrame, options: JobOptions) -> DataFrame:
    """Lines up to the one holding the last wanted record, by a unique integer ``line_no``.

    With ``max_records`` set, ranges of positions are decoded from the low end on, each wider
    than the one before, until enough records have passed; then the last one is refined.
    """
    wanted = options.max_records
    if wanted is None:
        return lines
    if wanted == 0:
        return lines.where(F.lit(False))
    position = F.col("line_no")
    low, last = lines.agg(F.min(position), F.max(position)).first()
    if low is None:
        return lines
    size = max(FIRST, GROWTH * wanted)
    while True:
        high = min(low + size - 1, last)
        width = -(-(high - low + 1) // RANGES)
        inside = lines.where(position.between(low, high))
        ranges = F.expr(f"(line_no - {low}) div {width}")
        hit, total = _range_of_nth(_passing(inside, options), [ranges.alias("range")], wanted)
        if hit is None:
            if high == last:
                return lines
            wanted, low, size = wanted - total, high + 1, size * GROWTH
            continue
        low += hit["range"] * width
        if width == 1:
            return lines.where(position <= low)
        wanted, last, size = wanted - hit["before"], min(low + width - 1, high), width


def limit_source(spark: SparkSession, options: JobOptions, unreadable: Sequence[str] = ()) -> DataFrame:
    """Lines of the source in file order, up to the one holding the last wanted record.

    A small limit is found among the first lines, which are read a few splits at a time; a few
    megabytes of them become part of the plan. Else files are counted in batches that grow, and in
    the file of the limit splits, a few at a time, too. What is found is the number of the last line in
    its file, so the lines up to it are the same however Spark cuts splits by then; lines behind
    it are not decoded, and nothing is stored. ``unreadable`` files are read as far as
    they go, and a null line stands for the rest of each one before the limit.
    """
    uri, region, lenient = options.require_source(), options.region, bool(unreadable)
    everything = surviving_lines(spark, uri, unreadable, region)
    if options.max_records is None:
        return everything
    if options.max_records == 0:
        return everything.where(F.lit(False))
    if options.max_records <= HEAD_LINES and not lenient:
        head = _head(spark, options, list_files(spark, uri, region))
        if head is not None:
            return head
    found = find_limit(spark, options, lenient)
    if found is None:
        return everything
    last = lines_upto(split_lines(spark, uri, region, found.previous, found.file, lenient), found.cut)
    if found.previous is None:
        return last
    cut = read_lines(spark, uri, region, upto=found.previous, ignore_corrupt=lenient).unionByName(last)
    passed_by = sorted(name for name in unreadable if name < found.file)
    return cut.unionByName(faults(spark, passed_by)) if passed_by else cut


def numbered_limit(numbered: DataFrame, options: JobOptions) -> DataFrame:
    """Lines of ``sources.lines.numbered_lines`` over the same source, cut at ``max_records``."""
    if options.max_records is None:
        return numbered
    found = find_limit(numbered.sparkSession, options) if options.max_records else None
    if found is None:
        return numbered if options.max_records else numbered.where(F.lit(False))
    file, row = F.col("line_no.file"), F.col("line_no.row")
    return numbered.where((file < found.file) | ((file == found.file) & (row < found.cut.lines)))


def find_limit(spark: SparkSession, options: JobOptions, ignore_corrupt: bool = False) -> Limit | None:
    """The file with the last wanted record, and where in it, or None if there are fewer."""
    uri, region, wanted = options.require_source(), options.region, options.max_records
    files, start, step = list_files(spark, uri, region), 0, 1
    while start < len(files):
        batch, previous = files[start : start + step], files[start - 1] if start else None
        if len(batch) > 1:
            lines = read_lines(spark, uri, region, previous, batch[-1], ignore_corrupt=ignore_corrupt)
            passing = _passing(lines, options)
            hit, passed = _range_of_nth(passing, [F.col("line_no.file").alias("file")], wanted)
            if hit is not None:
                wanted, passed, at = wanted - hit["before"], 0, files.index(hit["file"])
                batch, previous = [files[at]], files[at - 1] if at else None
        if len(batch) == 1:
            cut, passed = cut_in_file(split_lines(spark, uri, region, previous, batch[0], ignore_corrupt), options, wanted)
            if cut is not None:
                return Limit(batch[0], previous, cut)
        start, step, wanted = start + step, step * 2, wanted - passed
    return None


def _as_bytes(lines: DataFrame) -> DataFrame:
    """``value`` as binary, or back as text: bytes that are no UTF-8 stay what they are."""
    other = "string" if dict(lines.dtypes)["value"] == "binary" else "binary"
    return lines.withColumn("value", F.col("value").cast(other))


def _head(spark: SparkSession, options: JobOptions, files: list[str]) -> DataFrame | None:
    """The cut lines if the limit, or the end of the source, is among the first lines; else None.

    Positions and sizes of the wanted number of lines come to the driver, then of more, up to
    HEAD_LINES. Of a file, Spark runs one split, then some more, until it has them. The lines
    themselves follow if those of the last file, up to the cut, have HEAD_BYTES at most.
    """
    uri, region = options.require_source(), options.region
    wanted, room, previous = options.max_records, HEAD_LINES, None
    columns = ("line_no.block", "line_no.row", F.octet_length("value").alias("size"), "passes")
    for file in files[:HEAD_FILES]:
        one_file = read_lines(spark, uri, region, after=previous, upto=file)
        tested = with_passes(classify_lines(one_file), options).select(*columns)
        earlier = None if previous is None else read_lines(spark, uri, region, upto=previous)
        asked = min(wanted, room)
        while True:
            rows = sorted(tested.take(asked), key=lambda r: (r.block, r.row))
            hits = [k for k, r in enumerate(rows) if r.passes]
            if len(hits) >= wanted:
                return _fetched(one_file, rows[: hits[wanted - 1] + 1], earlier)
            if len(rows) < asked:
                break
            if asked == room:
                return None
            asked = min(2 * asked, room)
        wanted, room, previous = wanted - len(hits), room - len(rows), file
        if room == 0:
            return None
    return read_source(spark, options) if len(files) <= HEAD_FILES else None


def _fetched(one_file: DataFrame, rows: list, earlier: DataFrame | None) -> DataFrame | None:
    """``earlier`` and the lines of one file at the positions of ``rows``, its first ones, as part of
    the plan; None if they are too large for the driver or not there any more."""
    if sum(r.size for r in rows) > HEAD_BYTES:
        return None
    block, row = F.col("line_no.block"), F.col("line_no.row")
    last = rows[-1]
    upto = _as_bytes(one_file).where((block < last.block) | ((block == last.block) & (row <= last.row)))
    found = sorted((*r.line_no, r.value) for r in upto.take(len(rows)))
    if [f[1:3] for f in found] != [(r.block, r.row) for r in rows]:
        return None
    lines = one_file.sparkSession.createDataFrame(found, "file string, block long, row long, value binary")
    cut = lines.select(F.struct("file", "block", "row").alias("line_no"), F.col("value").cast("string").alias("value"))
    return cut if earlier is None else earlier.unionByName(cut)


def _passing(lines: DataFrame, options: JobOptions) -> DataFrame:
    return with_passes(classify_lines(lines), options).where("passes").select("line_no")


def _range_of_nth(passing: DataFrame, ranges: list[Column], wanted: int):
    """The first range at whose end ``wanted`` rows have been seen, or None, and all rows seen."""
    counts = passing.groupBy(*ranges).agg(F.count("*").alias("n"))
    names = [c for c in counts.columns if c != "n"]
    running = F.sum("n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))
    here = F.struct(*names, (F.col("seen") - F.col("n")).alias("before"))
    found = counts.withColumn("seen", running).agg(
        F.min(F.when(F.col("seen") >= wanted, here)).alias("hit"),
        F.coalesce(F.max("seen"), F.lit(0)).alias("total"),
    )
    return found.first()


def cut_in_file(one_file: DataFrame, options: JobOptions, wanted: int) -> tuple[Cut | None, int]:
    """Where the ``wanted``-th passing line of a file is, or None; and how many pass as far as was read.

    Splits are counted from the first on, twice as many each time; one that has enough is not read on.
    """
    block = F.col("line_no.block")

    def tested(where: Column | None = None) -> DataFrame:
        return with_passes(classify_lines(one_file, where), options).select(block.alias("block"), "length", "passes")

    counts = tested().mapInArrow(_counting(wanted), "block long, length long, lines long, passing long")
    asked = 1
    while True:
        rows, lines, passed = sorted(counts.take(asked)), 0, 0
        for row in rows:
            if passed + row.passing >= wanted:
                place = tested(block == row.block).mapInArrow(_placing(wanted - passed), "place long").first()[0]
                return Cut(lines + place + 1, row.block + row.length), wanted
            lines, passed = lines + row.lines, passed + row.passing
        if len(rows) < asked:
            return None, passed
        asked *= 2


def lines_upto(one_file: DataFrame, cut: Cut) -> DataFrame:
    """The lines of ``one_file`` up to a cut, however it is split by now.

    Later splits are dropped line by line before anything is decoded. One row per split of the file goes to every task.
    """
    near = one_file.select("line_no", "value").where(F.col("line_no.block") < cut.end)
    return with_place(near, few_splits=True).where(F.col("place") < cut.lines).drop("place")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """Runs of rows of one split: the split's start, first row and end."""
    blocks = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(blocks[a]), a, b


def _counting(wanted: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in batches:
            passes, lengths = batch.column("passes").to_numpy(zero_copy_only=False), batch.column("length")
            for block, a, b in _stretches(batch):
                entry = found.setdefault(block, [lengths[a].as_py(), 0, 0])
                entry[1] += b - a
                entry[2] += int(passes[a:b].sum())
            if any(e[2] >= wanted for e in found.values()):
                break
        rows = [(block, *entry) for block, entry in sorted(found.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["block", "length", "lines", "passing"])

    return count


def _placing(wanted: int):
    """The number of a split's ``wanted``-th passing line among its lines."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, passed = 0, 0
        for batch in batches:
            hits = np.flatnonzero(batch.column("passes").to_numpy(zero_copy_only=False))
            if passed + len(hits) >= wanted:
                yield pa.RecordBatch.from_pydict({"place": [lines + int(hits[wanted - passed - 1])]})
                return
            lines, passed = lines + batch.num_rows, passed + len(hits)

    return place
