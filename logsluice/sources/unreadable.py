"""Input files that cannot be read to their end, such as a packed file that was cut off.

Spark either ends the job at such a file or, told to ignore it, hides the loss. Here each one is
found by reading, named with its error, and read as far as it goes; one more line without a value
stands for what is missing, so that every report counts it as an ``io_error``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.schema import LINE_NO
from logsluice.sources.lines import list_files, read_lines

# Behind every split of a file.
AT_END = (1 << 63) - 1
TABLE = "file string, error string"


def find_unreadable(spark: SparkSession, path: str | list[str], region: str | None = None) -> dict[str, str]:
    """Files that fail when they are read, with their errors; the others are read to their end.

    All files are read in one job. A file that ends it is set apart, the rest is read again in
    two halves, and so on: files that were read without an error are not read a second time.
    A failure that names no file, as when the cluster is out of memory, is not a file's fault and is raised.
    """
    found: dict[str, str] = {}
    everything = list_files(spark, path, region)
    waiting = [everything]
    while waiting:
        files = waiting.pop()
        if not files:
            continue
        before = everything[at - 1] if (at := everything.index(files[0])) else None
        lines = read_lines(spark, path, region, after=before, upto=files[-1], without=sorted(found))
        try:
            lines.agg(F.count("*")).collect()
        except Exception as error:
            bad = _named(error, files, found)
            if bad is None:
                raise
            found[bad] = _cause(error)
            if half := len(files) // 2:
                waiting += [files[half:], files[:half]]
    return found


def _named(error: Exception, files: list[str], found: dict[str, str]) -> str | None:
    """The file of ``files`` that an error is about; the longest name if several are parts of each other."""
    text = str(error)
    if isinstance(error, PySparkException):
        text += str(error.getMessageParameters())
    # A listing writes file:///a where positions have file:/a.
    text = text.replace(":///", ":/")
    return max((f for f in files if f in text and f not in found), key=len, default=None)


def _cause(error: Exception) -> str:
    lines = [x.strip() for x in str(error).splitlines()]
    causes = [x.removeprefix("Caused by: ") for x in lines if x.startswith("Caused by: ")]
    return (causes or lines)[-1][:1000]


def unreadable_table(spark: SparkSession, unreadable: dict[str, str]) -> DataFrame:
    """``file`` and ``error`` of what ``find_unreadable`` found, as a table."""
    return spark.createDataFrame(sorted(unreadable.items()), TABLE)


def surviving_lines(spark: SparkSession, path: str | list[str], unreadable: Collection[str], region: str | None = None) -> DataFrame:
    """Lines of all files: of the unreadable ones those before the fault, and a null one in its place."""
    if not unreadable:
        return read_lines(spark, path, region)
    names = sorted(unreadable)
    whole = read_lines(spark, path, region, without=names)
    partly = read_lines(spark, path, region, only=names, ignore_corrupt=True)
    return whole.unionByName(partly).unionByName(faults(spark, names))


def faults(spark: SparkSession, names: list[str]) -> DataFrame:
    """A line without a value behind all others of each file."""
    rows = [((name, AT_END, 0), None) for name in names]
    return spark.createDataFrame(rows, f"line_no {LINE_NO.simpleString()}, value string")
