"""Request logs and outcomes derived from the given tables.

``TRAFFIC`` and ``LINES`` are SQL that Spark and DuckDB both run. ``full_lines``
adds headers, bodies and timestamps; the SQL side states the rows it expects of
each template instead.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.sources.scratch import scratch_folder

TRAFFIC = """
SELECT
  event_id AS line_no,
  ts,
  user_id,
  event_type,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'get' WHEN 'purchase' THEN 'POST'
                  WHEN 'signup' THEN 'Put' ELSE 'DELETE' END AS method,
  CASE event_id % 5 WHEN 0 THEN concat('/api/v1/', event_type, '/', CAST(user_id AS STRING))
                    WHEN 1 THEN '/api' WHEN 2 THEN concat('/apix/', CAST(user_id AS STRING))
                    WHEN 3 THEN '/health' ELSE '/staff/keys' END AS path,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '?'
                    WHEN 3 THEN concat('?lang=en&Token=t', CAST(user_id AS STRING))
                    WHEN 4 THEN concat('email=u', CAST(user_id AS STRING), '@example.com&&q=a=b')
                    WHEN 5 THEN '?token' ELSE '?e%6Dail=x&page=2&KEY=' END AS query,
  CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 299 WHEN 3 THEN 300 WHEN 4 THEN 404
                    ELSE NULL END AS status,
  CASE WHEN event_id % 11 = 0 THEN CAST(0 AS BIGINT)
       ELSE CAST(round(value * 100) AS BIGINT) * 2000 END AS latency_us,
  CASE event_id % 30 WHEN 5 THEN 'no answer: read timed out' WHEN 11 THEN 'peer: Connection Refused (111)'
                     WHEN 17 THEN 'no TLS version in common'
                     WHEN 23 THEN 'broken pipe' ELSE NULL END AS error,
  event_id % 13 = 0 AS was_dry_run,
  CASE WHEN event_id % 17 = 0 THEN 503 WHEN event_id % 19 = 0 THEN NULL
       ELSE CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 299 WHEN 3 THEN 300
                              WHEN 4 THEN 404 ELSE NULL END END AS replayed_status
FROM events
"""

LINES = f"""
SELECT line_no,
  CASE line_no % 19
    WHEN 1 THEN 'no json here'
    WHEN 2 THEN ''
    WHEN 3 THEN '   '
    WHEN 4 THEN concat(ok, ' junk')
    WHEN 5 THEN concat('{{"path":"', path, '"}}')
    WHEN 6 THEN concat('{{"method":"GET","path":"', path, '","status":"200"}}')
    WHEN 7 THEN concat('{{"method":"GET","path":"', path, '","status":70000}}')
    WHEN 8 THEN concat('{{"method":5,"path":"', path, '"}}')
    WHEN 9 THEN concat(chr(9), ok, '  ')
    WHEN 10 THEN concat('{{"method":"GET","path":"', path, '","status":200.0}}')
    WHEN 11 THEN concat('{{"method":"GET","path":null}}')
    WHEN 12 THEN concat('{{"method":"GET","path":"', path, '","status":null,"extra":[1]}}')
    ELSE ok END AS value
FROM (SELECT *, concat('{{"method":"', method, '","path":"', path, '"',
        CASE WHEN query IS NULL THEN '' ELSE concat(',"query":"', query, '"') END,
        CASE WHEN status IS NULL THEN '' ELSE concat(',"status":', CAST(status AS STRING)) END, '}}') AS ok
      FROM ({TRAFFIC}) t0) t
"""

# JSON of the ``headers`` member by line_no % 6; @ stands for the user id.
HEADER_TEMPLATES = {
    1: '{"Accept":"text/html","Authorization":"Bearer @"}',
    2: '{"Set-Cookie":["id=@","s=1"],"X-Id":@,"x-flag":true,"X-None":null}',
    3: '{"accept":"a","X-A":"@","Accept":"b"}',
    4: '{"Host":"h","Keep-Alive":"1","X-List":["p",1,"@"],"bad name":"v","X-Bad":["ok","t\\tt","c\\u0001"],"X-Obj":{"k": [@]}}',
    5: "{}",
}

# Body text, content type and encoding by line_no % 10; @ stands for the user id.
BODY_TEMPLATES = {
    1: ('{"user":{"email":"u@","Password":"p@"},"data":@}', "application/json", None),
    2: ("password=secret&user=@", "application/x-www-form-urlencoded", "utf8"),
    3: ('{"b":@, "a":[{"Token":1,"ok":"@"}]}', "application/json; charset=utf-8", None),
    4: ('{"session":{"id":@},"d":{"d":{"d":{"d":{"d":{"ssn":[1,2],"k":@}}}}}}', "application/json", None),
    5: ('{"password":"@', "application/json", None),
    6: ('{"token":1,"a":@,"token":3}', "application/json", "utf8"),
    7: ('{"price":1.50,"n":1e2,"z":-0.0,"secret":null,"id":@}', "application/json", None),
    8: ('{"password":"@"}', "Application/JSON", None),
    9: ("aGVsbG8=", "application/json", "base64"),
}

BAD_BASE64_EVERY = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of fewer splits; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(_sql(spark, table(spark, sf_dir, "events"), TRAFFIC))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, spread(table(spark, sf_dir, "events")), LINES)


def _sql(spark: SparkSession, events: DataFrame, text: str) -> DataFrame:
    events.createOrReplaceTempView("logsluice_events")
    return spark.sql(text.replace("FROM events", "FROM logsluice_events"))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic with header JSON, bodies and an ISO timestamp."""
    user = F.col("user_id").cast("string")
    header, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    kind, encoding = F.lit(None).cast("string"), F.lit(None).cast("string")
    by_header, by_body = F.col("line_no") % 6, F.col("line_no") % 10
    for k, text in HEADER_TEMPLATES.items():
        header = F.when(by_header == k, F.replace(F.lit(text), F.lit("@"), user)).otherwise(header)
    for k, (text, content_type, coded) in BODY_TEMPLATES.items():
        body = F.when(by_body == k, F.replace(F.lit(text), F.lit("@"), user)).otherwise(body)
        kind = F.when(by_body == k, F.lit(content_type)).otherwise(kind)
        encoding = F.when(by_body == k, F.lit(coded)).otherwise(encoding)
    bad = F.col("line_no") % BAD_BASE64_EVERY == 9
    body = F.when(bad, F.lit("aGVsbG9=")).otherwise(body)
    rows = _timed(_sql(spark, spread(table(spark, sf_dir, "events")), TRAFFIC))
    return rows.select(
        "line_no",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "method",
        "path",
        "query",
        header.alias("headers"),
        body.alias("body"),
        encoding.alias("body_encoding"),
        kind.alias("content_type"),
        "status",
    )


def full_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per record; the header JSON is spliced in as written."""
    rows = records(spark, sf_dir)
    plain = F.to_json(F.struct(*[c for c in rows.columns if c not in ("line_no", "headers")]))
    opened = F.substring(plain, 2, 1 << 30)
    spliced = F.concat(F.lit('{"headers":'), F.coalesce("headers", F.lit("null")), F.lit(","), opened)
    return rows.select("line_no", spliced.alias("value"))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one; a local one only in local mode."""
    return scratch_folder(spark)


def write_torn(rows: DataFrame, folder: str, size: int) -> None:
    """The first bytes of a packed file of ``value``, as if writing it had been broken off."""

    def write(batches):
        for batch in batches:
            text = "".join(f"{v}\n" for v in batch.column(0).to_pylist())
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/torn.txt.gz", compression=None) as out:
                out.write(gzip.compress(text.encode())[:size])
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})
            return

    rows.select("value").coalesce(1).mapInArrow(write, "n long").collect()
