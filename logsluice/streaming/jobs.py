"""Streams: lines to requests and rejects, outcomes to windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from logsluice.functions.decode import utc_timestamp
from logsluice.operators.classify import classify_lines
from logsluice.operators.filters import with_passes
from logsluice.operators.sanitize import sanitize
from logsluice.operators.stats import outcome_cells, outcome_report, tally
from logsluice.options import JobOptions
from logsluice.schema import RECORD_LINE

REQUEST, FILTERED, SANITIZE_ERROR = "request", "filtered", "sanitize_error"


def disposed_lines(lines: DataFrame, options: JobOptions) -> DataFrame:
    """Every line with its ``disposition`` and, for requests, the sanitized request.

    Stateless, for streams and batches alike. ``disposition`` is ``request``,
    ``filtered``, ``sanitize_error``, ``blank``, ``io_error`` or ``json_error``;
    ``value`` is kept only for lines that could not be decoded or sanitized.
    """
    if options.max_records is not None:
        raise ValueError("max_records needs a global order of lines, which a stream does not have")
    passed = with_passes(classify_lines(lines), options)
    timed = passed.withColumn("ts", utc_timestamp("timestamp"))
    # Lines that are not sent need no rewriting.
    for name in ("query", "headers", "body"):
        timed = timed.withColumn(name, F.when(F.col("passes"), F.col(name)))
    requests = sanitize(timed, options)
    sent = F.col("passes") & F.col("sanitize_error").isNull()
    disposition = (
        F.when(F.col("line_class") != RECORD_LINE, F.col("line_class"))
        .when(~F.col("passes"), FILTERED)
        .when(F.col("sanitize_error").isNotNull(), SANITIZE_ERROR)
        .otherwise(REQUEST)
    )
    rejected = (F.col("line_class") != RECORD_LINE) | (F.col("passes") & ~sent)
    fields = ("method", "url", "headers", "body", "content_type", "body_unparsed")
    return requests.select(
        "line_no",
        "ts",
        disposition.alias("disposition"),
        F.when(rejected, F.col("value")).alias("value"),
        *(F.when(sent, F.col(name)).alias(name) for name in fields),
    )


def start_request_stream(
    lines: DataFrame, options: JobOptions, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write requests and rejects in one pass, exactly once, partitioned by disposition."""
    writer = disposed_lines(lines, options).writeStream.partitionBy("disposition")
    return _start(writer, path, checkpoint, trigger)


def windowed_cells(outcomes: DataFrame, window: str, watermark: str) -> DataFrame:
    """Outcome counts per event-time window; late rows are dropped after ``watermark``."""
    late = outcomes.withWatermark("ts", watermark)
    cells = outcome_cells(late, F.window("ts", window).alias("window"))
    bounds = ("window.start", "window.end")
    return cells.select(*(F.col(b).alias(f"window_{b[7:]}") for b in bounds), *cells.columns[1:])


def start_window_stats(
    outcomes: DataFrame, window: str, watermark: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write each window's counts once, when the watermark has passed its end."""
    writer = windowed_cells(outcomes, window, watermark).writeStream.outputMode("append")
    return _start(writer, path, checkpoint, trigger)


def window_report(cells: DataFrame) -> DataFrame:
    """Statistics per window from stored counts; cells of several runs add up."""
    group = ("window_start", "window_end")
    return outcome_report(tally(cells, *group), *group)


class LateRows(StreamingQueryListener):
    """Adds up the rows that queries drop behind their watermarks, over their whole life.

    Register it with ``spark.streams.addListener`` before the queries start. A lower bound,
    since Spark counts after partial aggregation.
    """

    def __init__(self):
        self._dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        name = str(event.progress.id)
        self._dropped[name] = self._dropped.get(name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def dropped(self, query: StreamingQuery) -> int:
        """By this query and its earlier runs from the same checkpoint, since the listener was added."""
        return self._dropped.get(str(query.id), 0)


def start_parquet(rows: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Append the rows of a stream to a Parquet folder, exactly once."""
    return _start(rows.writeStream, path, checkpoint, trigger)


def _start(writer, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.format("parquet").option("checkpointLocation", checkpoint).start(path)
