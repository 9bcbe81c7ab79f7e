"""Turn decoded records into requests without private data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.body import decode_base64, is_base64, redact_bodies, valid_base64
from logsluice.functions.headers import clean_headers
from logsluice.functions.query_string import redact_query, request_url
from logsluice.options import JobOptions
from logsluice.schema import RECORD

BAD_BASE64 = "base64"


def sanitize_error() -> Column:
    """Reason why a record cannot become a request, else null."""
    bad = is_base64(F.col("body_encoding")) & ~valid_base64(F.col("body"))
    return F.when(bad, F.lit(BAD_BASE64))


def sanitize(records: DataFrame, options: JobOptions) -> DataFrame:
    """Records to requests: private headers dropped, query and body redacted, URL built.

    Keeps all columns that are not part of the record. Records that cannot be
    turned into a request stay, with ``sanitize_error`` set; ``body_unparsed``
    marks JSON bodies sent on unredacted because they do not parse.
    """
    fields = {f.name for f in RECORD.fields}
    keys = [c for c in records.columns if c not in fields]
    keep = options.passthrough
    encoded = is_base64(F.col("body_encoding"))
    prepared = (
        records.withColumn("sanitize_error", sanitize_error())
        .withColumn("_bytes", F.when(encoded, decode_base64(F.col("body"))))
        .withColumn("_text", F.when(~encoded, F.col("body")))
        .withColumn("query", redact_query(F.col("query"), keep))
    )
    redacted = redact_bodies(prepared, keep, body="_text")
    requests = redacted.select(
        *keys,
        "method",
        request_url(options.base_url, F.col("path"), F.col("query")).alias("url"),
        clean_headers(F.col("headers"), keep).alias("headers"),
        F.coalesce("_bytes", F.encode("body_redacted", "UTF-8")).alias("body"),
        "content_type",
        "sanitize_error",
        "body_unparsed",
    )
    for step in options.extra_sanitizers:
        requests = step(requests)
    return requests


def sendable(requests: DataFrame) -> DataFrame:
    """Requests without a sanitize error."""
    return requests.where(F.col("sanitize_error").isNull()).drop("sanitize_error")
