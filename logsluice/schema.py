"""Column layouts shared by batch and streaming jobs."""

from pyspark.sql import types as T

# Position of a line in its input: file, byte offset of the split, row within the job.
LINE_NO = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)

HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

RECORD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("headers", HEADERS),
        T.StructField("body", T.StringType()),
        T.StructField("body_encoding", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("status", T.IntegerType()),
    ]
)

OUTCOME = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("latency_us", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("was_dry_run", T.BooleanType()),
    ]
)

# Classes a line can fall into; exactly one applies.
IO_ERROR, BLANK, JSON_ERROR, RECORD_LINE = "io_error", "blank", "json_error", "record"
