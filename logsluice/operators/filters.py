"""Record filters: alternatives within a kind, all kinds must hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.options import JobOptions
from logsluice.schema import RECORD_LINE


def method_filter(methods: Sequence[str]) -> Column:
    """Method is one of ``methods``, whatever its case."""
    return F.upper("method").isin([m.upper() for m in methods])


def path_prefix_filter(prefixes: Sequence[str]) -> Column:
    """Path starts with one of ``prefixes``: literal, case-sensitive, no segment boundary."""
    return reduce(Column.__or__, (F.col("path").startswith(p) for p in prefixes))


def status_filter(statuses: Sequence[int]) -> Column:
    """Recorded status is one of ``statuses``; a missing status counts as 0."""
    return F.coalesce("status", F.lit(0)).isin(list(statuses))


def build_predicate(options: JobOptions) -> Column:
    """All filters of ``options`` as one Column; true when there are none."""
    parts = list(options.extra_filters)
    if options.methods:
        parts.append(method_filter(options.methods))
    if options.path_prefixes:
        parts.append(path_prefix_filter(options.path_prefixes))
    if options.statuses:
        parts.append(status_filter(options.statuses))
    return reduce(Column.__and__, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(True))


def describe_filters(options: JobOptions) -> list[str]:
    """One label per active filter."""
    labels = []
    if options.methods:
        labels.append(f"method in {', '.join(options.methods)}")
    if options.path_prefixes:
        labels.append(f"path starts with {', '.join(options.path_prefixes)}")
    if options.statuses:
        labels.append(f"status in {', '.join(map(str, options.statuses))}")
    if options.extra_filters:
        labels.append(f"{len(options.extra_filters)} custom")
    return labels


def with_passes(classified: DataFrame, options: JobOptions) -> DataFrame:
    """Add ``passes``: the line is a record and meets every filter.

    A column instead of a filter, so that one scan counts both sides.
    """
    return classified.withColumn(
        "passes", (F.col("line_class") == RECORD_LINE) & build_predicate(options)
    )
