"""Assign every line to one class and decode the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions import decode
from logsluice.functions.headers import normalise_headers
from logsluice.schema import BLANK, IO_ERROR, JSON_ERROR, RECORD, RECORD_LINE


def classify_lines(lines: DataFrame, where: Column | None = None) -> DataFrame:
    """Add ``line_class`` and the record columns, which are null unless it is ``record``.

    ``where`` selects lines by columns that ``lines`` has. Give it here rather than to
    the result: filters on the result stay above the decoding, so a scan sees none of
    them. Classes are ``io_error`` (not UTF-8), ``blank``, ``json_error`` and ``record``.
    ``value`` is kept, so that rejects can be stored.
    """
    if where is not None:
        lines = lines.where(where)
    readable = F.when(F.is_valid_utf8("value"), decode.trim_white_space(F.col("value")))
    text, raw = F.col("_text"), F.get("_items", F.lit(0))
    valid = decode.is_whole(F.col("_items"), text)
    for name in decode.TEXT_FIELDS:
        required = name in ("method", "path")
        valid = valid & (decode.is_text if required else decode.is_text_or_null)(raw[name])
    valid = valid & decode.is_status_or_null(raw["status"], text)
    valid = valid & decode.headers_well_formed(raw["headers"], text)
    line_class = (
        F.when(text.isNull(), F.lit(IO_ERROR))
        .when(text == "", F.lit(BLANK))
        .when(valid, F.lit(RECORD_LINE))
        .otherwise(F.lit(JSON_ERROR))
    )
    values = {name: decode.text_value(raw[name]) for name in decode.TEXT_FIELDS}
    values["headers"] = normalise_headers(raw["headers"])
    values["status"] = decode.status_value(raw["status"])
    is_record = F.col("line_class") == RECORD_LINE
    return (
        lines.withColumn("_text", readable)
        .withColumn("_items", _evaluate_once(decode.guarded_parse(text)))
        .withColumn("line_class", _evaluate_once(line_class))
        .select(
            *lines.columns,
            "line_class",
            *(F.when(is_record, values[f.name]).alias(f.name) for f in RECORD.fields),
        )
    )


def _evaluate_once(value: Column) -> Column:
    """Keep the optimizer from copying ``value`` into every expression that uses it.

    A filter on decoded fields is otherwise pushed below the decoding, with the
    whole parse repeated for each field it mentions. Columns that depend on the
    partition number are never copied; this one does so in name only.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def rejected_lines(classified: DataFrame) -> DataFrame:
    """Lines that could not be read or decoded, with their text."""
    keys = [c for c in classified.columns if c not in {f.name for f in RECORD.fields}]
    return classified.where(F.col("line_class").isin(IO_ERROR, JSON_ERROR)).select(*keys)
