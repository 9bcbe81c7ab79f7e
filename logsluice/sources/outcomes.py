"""Outcome tables: one row per request that was sent elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.schema import OUTCOME


def as_outcomes(df: DataFrame, *keys: str) -> DataFrame:
    """Select the outcome columns of ``df`` with their declared types, plus ``keys``.

    An outcome that does not say whether it was a dry run was none.
    """
    columns = {f.name: F.col(f.name).cast(f.dataType) for f in OUTCOME.fields}
    columns["was_dry_run"] = F.coalesce(columns["was_dry_run"], F.lit(False))
    return df.select(*keys, *(c.alias(name) for name, c in columns.items()))


def read_outcomes(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    return as_outcomes(spark.read.parquet(path), *keys)


def stream_outcomes(
    spark: SparkSession, path: str, schema, *keys: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return as_outcomes(reader.parquet(path), *keys)
