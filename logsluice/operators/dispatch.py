"""Outcomes that are known without sending anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.headers import TOKEN
from logsluice.schema import OUTCOME, RECORD

_REQUEST_FIELDS = {f.name for f in RECORD.fields} | {"url", "sanitize_error", "body_unparsed"}


def dry_run(requests: DataFrame) -> DataFrame:
    """One outcome per request: no status, no latency, no error, flagged as dry run."""
    return _outcomes(requests, F.lit(None), F.lit(True))


def has_valid_method() -> Column:
    return F.col("method").rlike(TOKEN)


def invalid_method_outcomes(requests: DataFrame) -> DataFrame:
    """Outcomes of the requests that fail before sending: the method is not an HTTP token."""
    failed = requests.where(~has_valid_method())
    return _outcomes(failed, F.concat(F.lit("Invalid method "), "method"), F.lit(False))


def _outcomes(requests: DataFrame, error: Column, was_dry_run: Column) -> DataFrame:
    values = {"status": F.lit(None), "latency_us": F.lit(0), "error": error, "was_dry_run": was_dry_run}
    keys = [c for c in requests.columns if c not in _REQUEST_FIELDS]
    return requests.select(
        *keys, *(values[f.name].cast(f.dataType).alias(f.name) for f in OUTCOME.fields)
    )
