"""Outcome of one request: success, error category, latency bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error categories, with the texts that select them, in this order.
ERROR_CATEGORIES = (
    ("timeout", ("timeout", "timed out")),
    ("connection-refused", ("connection refused",)),
    ("tls", ("tls", "ssl", "certificate")),
)
OTHER_ERROR = "other"

# Latency range in microseconds and buckets per power of two (3 digits).
MAX_LATENCY_US = 60_000_000
SUB_BUCKET_BITS = 11


def error_category(error: Column) -> Column:
    """Category of an error text; null stays null."""
    text = F.lower(error)
    category = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, needles in ERROR_CATEGORIES:
        found = F.contains(text, F.lit(needles[0]))
        for needle in needles[1:]:
            found = found | F.contains(text, F.lit(needle))
        category = category.when(found, F.lit(name))
    return category.otherwise(F.lit(OTHER_ERROR))


def is_success(status: Column) -> Column:
    return F.coalesce((status >= 200) & (status < 300), F.lit(False))


def latency_bucket(latency_us: Column) -> Column:
    """Largest value that shares the latency's bucket; null for latencies not recorded.

    Buckets are exact below 2048 and then double their width with every power of
    two, so at most 17 191 exist between 1 and the 60 s clamp, whatever the data.
    """
    value = F.least(latency_us, F.lit(MAX_LATENCY_US).cast("bigint"))
    shift = F.greatest(F.length(F.bin(value)) - SUB_BUCKET_BITS, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    return F.when(latency_us > 0, low + width - 1)
