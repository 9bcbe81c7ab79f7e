"""DuckDB SQL giving the rows that each query must return."""

from __future__ import annotations

from checks.views import LINES, TRAFFIC

READS = (
    "upper(method) = 'GET' AND (starts_with(path, '/api') OR starts_with(path, '/health')) "
    "AND coalesce(status, 0) IN (200, 201, 0)"
)
GET_API = "upper(method) = 'GET' AND starts_with(path, '/api')"
URL_BASE = "http://replay.example.com:8080"

# Lines split into class and decoded fields.
CLASSED = f"""
WITH trimmed AS (SELECT line_no, value, trim(value, chr(9) || ' ') AS t FROM ({LINES}) l),
typed AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN NOT json_valid(t) THEN 'json_error'
    WHEN json_type(t) = 'OBJECT'
     AND coalesce(json_type(t, '$.method'), '') = 'VARCHAR' AND coalesce(json_type(t, '$.path'), '') = 'VARCHAR'
     AND coalesce(json_type(t, '$.query'), 'NULL') IN ('VARCHAR', 'NULL')
     AND (coalesce(json_type(t, '$.status'), 'NULL') = 'NULL'
          OR (json_type(t, '$.status') IN ('UBIGINT', 'BIGINT')
              AND CAST(t->>'$.status' AS BIGINT) BETWEEN 0 AND 65535))
    THEN 'record' ELSE 'json_error' END AS line_class FROM trimmed),
classed AS (SELECT line_no, value, line_class,
    CASE WHEN line_class = 'record' THEN t->>'$.method' END AS method,
    CASE WHEN line_class = 'record' THEN t->>'$.path' END AS path,
    CASE WHEN line_class = 'record' THEN t->>'$.query' END AS query,
    CASE WHEN line_class = 'record' THEN CAST(t->>'$.status' AS INTEGER) END AS status FROM typed)
"""


def funnel(passes: str, relation: str = "classed") -> str:
    return f"""SELECT count(*) AS total_lines, 
  count(*) FILTER (line_class = 'io_error') AS io_errors,
  count(*) FILTER (line_class = 'blank') AS blank_lines,
  count(*) FILTER (line_class = 'json_error') AS json_errors,
  count(*) FILTER (line_class = 'record' AND NOT ({passes})) AS filtered_count,
  count(*) FILTER (line_class = 'record' AND ({passes})) AS dispatched,
  CAST(0 AS BIGINT) AS sanitize_errors,
  count(*) FILTER (line_class IN ('io_error', 'json_error')) AS parse_errors FROM {relation}"""


# Every fiftieth line of the files is not UTF-8.
WITH_IO_ERRORS = """(SELECT * REPLACE (CASE WHEN line_no % 50 = 7 THEN 'io_error' ELSE line_class END AS line_class)
  FROM classed) f"""


def limited_funnel(passes: str, wanted: int) -> str:
    return f"""{CLASSED}, ranked AS (SELECT *, sum(CASE WHEN line_class = 'record' AND ({passes}) THEN 1 ELSE 0 END)
    OVER (ORDER BY line_no) AS seen FROM classed),
kept AS (SELECT * FROM ranked WHERE line_no <= coalesce(
    (SELECT min(line_no) FROM ranked WHERE seen >= {wanted}), (SELECT max(line_no) FROM ranked)))
{funnel(passes, "kept")}"""


def redacted(query: str, names: str) -> str:
    """Redaction written with lists: split at &, rewrite each pair, join again."""
    raw = f"CASE WHEN starts_with({query}, '?') THEN substr({query}, 2) ELSE {query} END"
    pairs = (
        f"list_transform(string_split({raw}, '&'), lambda p: CASE WHEN "
        f"lower(string_split(p, '=')[1]) IN ({names}) "
        f"THEN string_split(p, '=')[1] || '=[REDACTED]' ELSE p END)"
    )
    return (
        f"CASE WHEN {query} IS NULL THEN NULL WHEN ({raw}) = '' THEN {query} "
        f"WHEN starts_with({query}, '?') THEN '?' || array_to_string({pairs}, '&') "
        f"ELSE array_to_string({pairs}, '&') END"
    )


ALL_NAMES = "'email','phone','token','session','ssn','password','auth','key'"
KEPT_NAMES = "'email','phone','ssn','password','auth','key'"
QUERY = redacted("query", ALL_NAMES)
URL = (
    f"'{URL_BASE}' || path || CASE WHEN coalesce(query, '') = '' THEN '' "
    f"WHEN starts_with({QUERY}, '?') THEN {QUERY} ELSE '?' || {QUERY} END"
)

# (template, position, name, position in list, value); @ stands for the user id.
DECODED_HEADERS = """(1,0,'accept',0,'text/html'),(1,1,'authorization',0,'Bearer @'),
(2,0,'set-cookie',0,'id=@'),(2,0,'set-cookie',1,'s=1'),(2,1,'x-id',0,'@'),(2,2,'x-flag',0,'true'),(2,3,'x-none',0,'null'),
(3,0,'accept',0,'b'),(3,1,'x-a',0,'@'),
(4,0,'host',0,'h'),(4,1,'keep-alive',0,'1'),(4,2,'x-list',0,'p'),(4,2,'x-list',1,'@'),(4,3,'bad name',0,'v'),
(4,4,'x-bad',0,'ok'),(4,4,'x-bad',1,'t' || chr(9) || 't'),(4,4,'x-bad',2,'c' || chr(1)),(4,5,'x-obj',0,'{"k":[@]}')"""
CLEAN_2_TO_4 = """(2,0,'x-id',0,'@'),(2,1,'x-flag',0,'true'),(2,2,'x-none',0,'null'),
(3,0,'accept',0,'b'),(3,1,'x-a',0,'@'),
(4,0,'x-list',0,'p'),(4,0,'x-list',1,'@'),(4,1,'x-bad',0,'ok'),(4,1,'x-bad',1,'t' || chr(9) || 't'),(4,2,'x-obj',0,'{"k":[@]}')"""
CLEAN_HEADERS = f"(1,0,'accept',0,'text/html'),{CLEAN_2_TO_4}"
CLEAN_HEADERS_KEPT = f"(1,0,'accept',0,'text/html'),(1,1,'authorization',0,'Bearer @'),{CLEAN_2_TO_4}"


def header_rows(values: str) -> str:
    return f"""SELECT event_id AS line_no, CAST(pos AS INTEGER) AS pos, name, CAST(vpos AS INTEGER) AS vpos,
  replace(v, '@', CAST(user_id AS VARCHAR)) AS value
FROM events JOIN (VALUES {values}) h(k, pos, name, vpos, v) ON event_id % 6 = k"""


# (template, expected body, not parsed); @ stands for the user id.
BODIES = """(1,'{"data":@,"user":{"Password":"[REDACTED]","email":"[REDACTED]"}}',false),
(2,'password=secret&user=@',false),
(3,'{"a":[{"Token":"[REDACTED]","ok":"@"}],"b":@}',false),
(4,'{"d":{"d":{"d":{"d":{"d":{"k":@,"ssn":"[REDACTED]"}}}}},"session":"[REDACTED]"}',false),
(5,'{"password":"@',true),
(6,'{"a":@,"token":"[REDACTED]"}',false),
(7,'{"id":@,"n":100.0,"price":1.5,"secret":"[REDACTED]","z":-0.0}',false),
(8,'{"password":"@"}',false)"""
BODIES_KEPT = (
    BODIES.replace('"Token":"[REDACTED]"', '"Token":1')
    .replace('"session":"[REDACTED]"', '"session":{"id":@}')
    .replace('"token":"[REDACTED]"', '"token":3')
)


def bodies(values: str) -> str:
    return f"""SELECT event_id AS line_no, replace(b, '@', CAST(user_id AS VARCHAR)) AS body_redacted,
  unparsed AS body_unparsed FROM events JOIN (VALUES {values}) t(k, b, unparsed) ON event_id % 10 = k"""


REQUEST_COLUMNS = f"""line_no, method, {URL} AS url,
  CASE line_no % 6 WHEN 1 THEN 'accept' WHEN 2 THEN 'x-id,x-flag,x-none' WHEN 3 THEN 'accept,x-a'
    WHEN 4 THEN 'x-list,x-bad,x-obj' ELSE '' END AS header_names,
  replace(CASE line_no % 6 WHEN 1 THEN 'text/html' WHEN 2 THEN '@;true;null' WHEN 3 THEN 'b;@'
    WHEN 4 THEN 'p|@;ok|t' || chr(9) || 't;{{"k":[@]}}' ELSE '' END, '@', CAST(user_id AS VARCHAR)) AS header_values,
  CASE WHEN line_no % 10 = 9 THEN 'hello' ELSE replace(b, '@', CAST(user_id AS VARCHAR)) END AS body,
  CASE line_no % 10 WHEN 0 THEN NULL WHEN 2 THEN 'application/x-www-form-urlencoded'
    WHEN 3 THEN 'application/json; charset=utf-8' WHEN 8 THEN 'Application/JSON' ELSE 'application/json' END AS content_type"""
REQUESTS = f"""FROM ({TRAFFIC}) t LEFT JOIN (VALUES {BODIES}) e(k, b, unparsed) ON line_no % 10 = k
WHERE {READS} AND line_no % 40 <> 9"""

COUNTS = """count(*) AS attempted,
  count(*) FILTER (was_dry_run OR coalesce(status BETWEEN 200 AND 299, false)) AS succeeded,
  count(*) FILTER (NOT was_dry_run AND NOT coalesce(status BETWEEN 200 AND 299, false)) AS failed"""
CATEGORY = """CASE WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout'
  WHEN lower(error) LIKE '%connection refused%' THEN 'connection-refused'
  WHEN lower(error) LIKE '%tls%' OR lower(error) LIKE '%ssl%' OR lower(error) LIKE '%certificate%' THEN 'tls'
  ELSE 'other' END"""
# Bucket end by doubling ranges: exact below 2048, then 2048 buckets per range halved.
BUCKETED = f"""clamped AS (SELECT *, least(latency_us, 60000000) AS x FROM ({TRAFFIC}) t
  WHERE NOT was_dry_run AND latency_us > 0),
bucketed AS (SELECT *, CASE WHEN x < 2048 THEN x ELSE
  (x // CAST(pow(2, floor(log2(x)) - 10) AS BIGINT) + 1) * CAST(pow(2, floor(log2(x)) - 10) AS BIGINT) - 1 END
  AS bucket_us FROM clamped)"""


def percentile(q: str) -> str:
    return f"CAST(coalesce(min(bucket_us) FILTER (rn >= greatest(1, ceil(CAST({q} AS DOUBLE) * of))), 0) AS BIGINT)"


PERCENTILES = ", ".join(f"{percentile(q)} AS {n}" for q, n in (("0.50", "p50_us"), ("0.95", "p95_us"), ("0.99", "p99_us")))


def ranked(group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    over = f"PARTITION BY {group}" if group else ""
    return (
        f"ranked AS (SELECT *, row_number() OVER ({part}ORDER BY bucket_us) AS rn, "
        f"count(*) OVER ({over}) AS of FROM bucketed)"
    )


def report(group: str = "") -> str:
    """Statistics put together from separate queries, overall or per ``group``."""
    g, gs = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    on = f"USING ({group})" if group else "ON true"
    elapsed = "(epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE)"
    return f"""WITH {BUCKETED}, {ranked(group)},
base AS (SELECT {g}{COUNTS}, {elapsed} AS elapsed_secs FROM ({TRAFFIC}) t {gs}),
st AS (SELECT {g}string_agg(CAST(status AS VARCHAR) || '=' || n, ',' ORDER BY status) AS status_distribution FROM
  (SELECT {g}status, count(*) AS n FROM ({TRAFFIC}) t WHERE NOT was_dry_run AND status IS NOT NULL GROUP BY {g}status) s {gs}),
er AS (SELECT {g}string_agg(category || '=' || n, ',' ORDER BY category) AS error_categories FROM
  (SELECT {g}{CATEGORY} AS category, count(*) AS n FROM ({TRAFFIC}) t
   WHERE NOT was_dry_run AND error IS NOT NULL GROUP BY {g}category) e {gs}),
pc AS (SELECT {g}{PERCENTILES} FROM ranked {gs})
SELECT {g}attempted, succeeded, failed, coalesce(status_distribution, '') AS status_distribution,
  coalesce(error_categories, '') AS error_categories, elapsed_secs,
  CASE WHEN elapsed_secs > 0 THEN attempted / elapsed_secs ELSE CAST(0 AS DOUBLE) END AS throughput_rps,
  coalesce(p50_us, 0) AS p50_us, coalesce(p95_us, 0) AS p95_us, coalesce(p99_us, 0) AS p99_us
FROM base LEFT JOIN st {on} LEFT JOIN er {on} LEFT JOIN pc {on}"""


FUNNEL_AND_REPORT = f"""(SELECT total_lines, parse_errors, filtered_count FROM ({CLASSED} {funnel(READS)}) f) a,
  ({report()}) b"""

SUMMARY = f"""WITH r AS (SELECT * FROM {FUNNEL_AND_REPORT}),
parts AS (
{" UNION ALL ".join(
    f"SELECT 1 AS part, {i} AS pos, 'Run complete — Summary:' AS section, '{label}' AS label, {value} AS value FROM r"
    for i, (label, value) in enumerate((
        ("Lines read", "CAST(total_lines AS VARCHAR)"),
        ("Parse errors", "CAST(parse_errors AS VARCHAR)"),
        ("Filtered", "CAST(filtered_count AS VARCHAR)"),
        ("Attempted", "CAST(attempted AS VARCHAR)"),
        ("Succeeded (2xx)", "CAST(succeeded AS VARCHAR)"),
        ("Failed", "CAST(failed AS VARCHAR)"),
        ("Elapsed", "printf('%.2fs', elapsed_secs)"),
        ("Throughput", "printf('%.1f req/s', throughput_rps)"),
    )))}
{"".join(
    f" UNION ALL SELECT 2, {i}, 'Latency (µs)', '{p}', CAST({p}_us AS VARCHAR) FROM r"
    for i, p in enumerate(("p50", "p95", "p99")))}
 UNION ALL SELECT 3, status, 'Status distribution', CAST(status AS VARCHAR), CAST(count(*) AS VARCHAR)
   FROM ({TRAFFIC}) t WHERE NOT was_dry_run AND status IS NOT NULL GROUP BY status
 UNION ALL SELECT 4, 0, 'Error categories', {CATEGORY} AS c, CAST(count(*) AS VARCHAR)
   FROM ({TRAFFIC}) t WHERE NOT was_dry_run AND error IS NOT NULL GROUP BY c)
SELECT CAST(row_number() OVER (ORDER BY part, pos, label) - 1 AS INTEGER) AS ord, section, label, value FROM parts"""

# Level after every start or end, then the peak per minute including what it began with.
IN_FLIGHT = f"""WITH edges AS (
  SELECT epoch_us(ts) AS instant, 1 AS d FROM ({TRAFFIC}) a WHERE latency_us > 0
  UNION ALL SELECT epoch_us(ts) + latency_us, -1 FROM ({TRAFFIC}) b WHERE latency_us > 0),
netted AS (SELECT instant, CAST(sum(d) AS BIGINT) AS d FROM edges GROUP BY instant),
levels AS (SELECT instant, CAST(sum(d) OVER (ORDER BY instant) AS BIGINT) AS after, CAST(coalesce(sum(d) OVER (
  ORDER BY instant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM netted)
SELECT CAST(instant // 60000000 AS BIGINT) * 60000000 AS minute_us,
  greatest(max(after), arg_min(before, instant)) AS peak FROM levels GROUP BY instant // 60000000"""

WINDOWS = f"""WITH {BUCKETED},
windowed AS (SELECT *, epoch_us(ts) // 21600000000 * 21600000000 AS window_start_us FROM ({TRAFFIC}) t),
closed AS (SELECT * FROM windowed
  WHERE window_start_us + 21600000000 <= (SELECT max(epoch_us(ts)) FROM ({TRAFFIC}) m) - 3600000000),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY bucket_us) AS rn, count(*) OVER (PARTITION BY w) AS of
  FROM (SELECT *, epoch_us(ts) // 21600000000 * 21600000000 AS w FROM bucketed) b),
pc AS (SELECT w AS window_start_us, {PERCENTILES} FROM ranked GROUP BY w)
SELECT CAST(window_start_us AS BIGINT) AS window_start_us, attempted, succeeded, failed,
  coalesce(p50_us, 0) AS p50_us, coalesce(p95_us, 0) AS p95_us, coalesce(p99_us, 0) AS p99_us
FROM (SELECT window_start_us, {COUNTS} FROM closed GROUP BY window_start_us) c LEFT JOIN pc USING (window_start_us)"""

DISPOSED = f"""SELECT CASE WHEN NOT ({READS}) THEN 'filtered' WHEN line_no % 40 = 9 THEN 'sanitize_error'
    ELSE 'request' END AS disposition,
  CASE WHEN {READS} AND line_no % 40 <> 9 THEN method END AS method,
  CASE WHEN {READS} AND line_no % 40 <> 9 THEN {URL} END AS url,
  CASE WHEN {READS} AND line_no % 40 <> 9 THEN CASE WHEN line_no % 10 = 9 THEN 'hello'
    ELSE replace(b, '@', CAST(user_id AS VARCHAR)) END END AS body,
  CASE WHEN {READS} AND line_no % 40 = 9 THEN concat('{{"headers":', CASE line_no % 6
      WHEN 1 THEN '{{"Accept":"text/html","Authorization":"Bearer @"}}' WHEN 3 THEN '{{"accept":"a","X-A":"@","Accept":"b"}}'
      WHEN 5 THEN '{{}}' ELSE 'null' END,
    ',"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '","method":"', method, '","path":"', path, '"',
    CASE WHEN query IS NULL THEN '' ELSE concat(',"query":"', query, '"') END,
    ',"body":"aGVsbG9=","body_encoding":"base64","content_type":"application/json"',
    CASE WHEN status IS NULL THEN '' ELSE concat(',"status":', status) END, '}}') END AS value
FROM ({TRAFFIC}) t LEFT JOIN (VALUES {BODIES}) e(k, b, unparsed) ON line_no % 10 = k"""


def filtered(predicate: str) -> str:
    return f"SELECT line_no, method, path, status FROM ({TRAFFIC}) t WHERE {predicate}"


# The lines of one file of four are lost; one line stands for them.
SURVIVING = """(SELECT line_class, method, path, status FROM classed WHERE line_no % 4 <> 2
  UNION ALL SELECT 'io_error', NULL, NULL, NULL) s"""

# Five deliveries by time, every tenth row in the last; a window of 6 hours is late an hour behind all earlier deliveries.
LATE_ROWS = f"""WITH bounds AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
chunked AS (SELECT line_no, epoch_us(ts) AS us, CASE WHEN line_no % 10 = 0 THEN 4
    ELSE least(4, (epoch_us(ts) - low) * 5 // (high - low)) END AS chunk FROM ({TRAFFIC}) t, bounds),
marks AS (SELECT c.chunk, max(e.latest) - 3600000000 AS mark
  FROM (SELECT DISTINCT chunk FROM chunked) c
  LEFT JOIN (SELECT chunk, max(us) AS latest FROM chunked GROUP BY chunk) e ON e.chunk < c.chunk GROUP BY c.chunk)
SELECT line_no, CASE WHEN (us // 21600000000 + 1) * 21600000000 <= mark THEN 'late' ELSE 'on_time' END AS verdict
FROM chunked JOIN marks USING (chunk)"""


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    for name in ("repeated_outcomes", "stream_running_report", "stream_repeated_outcomes"):
        found[name] = found["stats_report"]
    return found | {
        "rerun_requests": found["stored_requests"],
        "stream_status_pairs": found["status_pairs"],
        "stream_peak_requests": found["peak_requests_in_flight"],
        "stream_replay_gaps": found["replay_gaps"],
    }


def _oracle_sql() -> dict[str, str]:
    traffic = f"({TRAFFIC}) t"
    page_query = "regexp_extract(url, '\\?([^#]*)', 1) || '&Session=s' || page_id || '&lang=x'"
    return {
        "filter_method": filtered("upper(method) IN ('GET', 'POST')"),
        "filter_path_prefix": filtered("starts_with(path, '/api') OR starts_with(path, '/health')"),
        "filter_status": filtered("coalesce(status, 0) IN (200, 404, 0)"),
        "filter_chain": filtered(READS),
        "filter_custom": filtered("length(path) > 8"),
        "line_classes": f"{CLASSED} SELECT line_class, count(*) AS n FROM classed GROUP BY line_class",
        "decoded_records": f"{CLASSED} SELECT line_no, method, path, query, status FROM classed "
        "WHERE line_class = 'record'",
        "rejects": f"{CLASSED} SELECT line_no, value, line_class FROM classed "
        "WHERE line_class IN ('io_error', 'json_error')",
        "ingest_funnel": f"{CLASSED} {funnel(READS)}",
        "ingest_funnel_max_records": limited_funnel(GET_API, 500),
        "file_funnel": f"{CLASSED} {funnel(GET_API, WITH_IO_ERRORS)}",
        "file_funnel_max_records": limited_funnel(GET_API, 500),
        "query_redacted": f"SELECT line_no, {QUERY} AS query, {redacted('query', KEPT_NAMES)} AS query_token_kept "
        f"FROM {traffic}",
        "page_queries": f"SELECT page_id, {redacted('q', ALL_NAMES)} AS query "
        f"FROM (SELECT page_id, {page_query} AS q FROM pages) p",
        "request_urls": f"SELECT line_no, {URL} AS url FROM {traffic}",
        "header_values": header_rows(DECODED_HEADERS),
        "headers_clean": header_rows(CLEAN_HEADERS),
        "headers_clean_passthrough": header_rows(CLEAN_HEADERS_KEPT),
        "body_redacted": bodies(BODIES),
        "body_redacted_passthrough": bodies(BODIES_KEPT),
        "document_bodies": """SELECT doc_id, md5('{"author":{"Email":"[REDACTED]","lang":' || to_json(lang) ||
            '},"doc_id":' || doc_id || ',"text":' || to_json(text) || '}') AS body_md5 FROM documents""",
        "body_decoded": "SELECT event_id AS line_no, CASE WHEN event_id % 40 = 9 THEN NULL ELSE 'hello' END AS body, "
        "event_id % 40 = 9 AS rejected FROM events WHERE event_id % 10 = 9",
        "sanitized_requests": f"SELECT {REQUEST_COLUMNS} {REQUESTS}",
        "extra_sanitizer": f"SELECT line_no, lower({URL}) AS url {REQUESTS}",
        "stored_requests": f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {REQUEST_COLUMNS} {REQUESTS}",
        "dry_run_stats": f"""WITH j AS (SELECT *, {READS} AS passes, line_no % 40 = 9 AS bad FROM {traffic}),
            s AS (SELECT count(*) AS total_lines, count(*) FILTER (passes AND bad) AS parse_errors,
              count(*) FILTER (NOT passes) AS filtered_count, count(*) FILTER (passes AND NOT bad) AS attempted,
              (epoch_us(max(ts) FILTER (passes AND NOT bad)) - epoch_us(min(ts) FILTER (passes AND NOT bad)))
                / CAST(1000000 AS DOUBLE) AS elapsed_secs FROM j)
            SELECT total_lines, parse_errors, filtered_count, attempted, attempted AS succeeded,
              CAST(0 AS BIGINT) AS failed, '' AS status_distribution, '' AS error_categories, elapsed_secs,
              attempted / elapsed_secs AS throughput_rps, CAST(0 AS BIGINT) AS p50_us, CAST(0 AS BIGINT) AS p95_us,
              CAST(0 AS BIGINT) AS p99_us FROM s""",
        "dry_run_outcomes": "SELECT line_no, CAST(NULL AS INTEGER) AS status, CAST(0 AS BIGINT) AS latency_us, "
        f"CAST(NULL AS VARCHAR) AS error, true AS was_dry_run {REQUESTS}",
        "invalid_method": "SELECT event_id AS line_no, CAST(NULL AS INTEGER) AS status, CAST(0 AS BIGINT) AS latency_us, "
        "'other' AS category, false AS was_dry_run FROM events WHERE event_id % 10 IN (3, 7)",
        "outcome_counts": f"SELECT {COUNTS} FROM {traffic}",
        "status_distribution": f"SELECT status, count(*) AS n FROM {traffic} "
        "WHERE NOT was_dry_run AND status IS NOT NULL GROUP BY status",
        "error_categories": f"SELECT {CATEGORY} AS category, count(*) AS n FROM {traffic} "
        "WHERE NOT was_dry_run AND error IS NOT NULL GROUP BY 1",
        "latency_buckets": f"WITH {BUCKETED} SELECT CAST(bucket_us AS BIGINT) AS bucket_us, count(*) AS n "
        "FROM bucketed GROUP BY 1",
        "latency_percentiles": f"WITH {BUCKETED}, {ranked()} SELECT {PERCENTILES} FROM ranked",
        "latency_percentiles_by_method": f"WITH {BUCKETED}, {ranked('method')} "
        f"SELECT method, {PERCENTILES} FROM ranked GROUP BY method",
        "stats_report": report(),
        "stats_report_by_method": report("method"),
        "full_report": f"SELECT * FROM {FUNNEL_AND_REPORT}",
        "stats_json": f"SELECT * FROM {FUNNEL_AND_REPORT}",
        "summary": SUMMARY,
        "rate_over_cap": f"""SELECT CAST(epoch_us(ts) // 3600 // 1000000 AS BIGINT) * 1000000 AS second_us,
            count(*) AS requests, count(*) - 10 AS excess FROM {traffic} GROUP BY 1 HAVING count(*) > 10""",
        "peak_requests_in_flight": IN_FLIGHT,
        "status_pairs": f"""SELECT recorded_status, replayed_status, found_in, count(*) AS n,
            CASE WHEN found_in = 'both' THEN recorded_status IS NOT DISTINCT FROM replayed_status END AS matched
            FROM (SELECT CASE WHEN line_no % 23 <> 0 THEN status END AS recorded_status,
                CASE WHEN line_no % 29 <> 0 THEN replayed_status END AS replayed_status,
                CASE WHEN line_no % 23 = 0 THEN 'replayed' WHEN line_no % 29 = 0 THEN 'recorded' ELSE 'both' END AS found_in
              FROM {traffic} WHERE line_no % 23 <> 0 OR line_no % 29 <> 0) p GROUP BY 1, 2, 3""",
        "replay_gaps": f"""SELECT line_no, user_id,
            epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, line_no)) AS gap_us,
            epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS offset_us FROM {traffic}""",
        "stream_requests": DISPOSED,
        "stream_window_stats": WINDOWS,
        "line_numbers": f"SELECT line_no % 4 AS part, row_number() OVER (PARTITION BY line_no % 4 ORDER BY line_no) - 1 AS row, "
        f"value FROM ({LINES}) l",
        "corrupt_files": f"{CLASSED} {funnel(READS, SURVIVING)}",
        "stream_limited": f"""SELECT total_lines, blank_lines, json_errors, filtered_count, dispatched
            FROM ({limited_funnel(GET_API, 1500)}) f""",
        "stream_late_rows": LATE_ROWS,
    }
