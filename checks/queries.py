"""One query per operator, each over whole tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from logsluice.functions.body import decode_base64, is_base64, redact_bodies
from logsluice.functions.headers import clean_headers
from logsluice.functions.query_string import redact_query, request_url
from logsluice.operators import stats
from logsluice.operators.classify import classify_lines, rejected_lines
from logsluice.operators.compare import first_outcomes, first_outcomes_of_stream, pair_counts, status_mismatch
from logsluice.operators.filters import build_predicate
from logsluice.operators.timing import peak_in_flight, peak_of_seconds, rate_exceedance, replay_schedule, schedule_of_seconds
from logsluice.options import JobOptions
from logsluice.plans import jobs
from logsluice.plans.sinks import summary_lines, write_requests, write_stats_json
from logsluice.sources.lines import numbered_lines, stream_lines
from logsluice.sources.outcomes import stream_outcomes
from logsluice.streaming import landing
from logsluice.streaming.jobs import start_request_stream, start_window_stats, window_report
from logsluice.streaming.timing import start_request_seconds, start_seconds_in_flight

Query = Callable[[SparkSession, str], DataFrame]

BASE_URL = "http://replay.example.com:8080/"
API_READS = JobOptions.create(
    BASE_URL, methods=["get"], path_prefixes=["/api", "/health"], statuses=[200, 201, 0]
)
EVERYTHING = JobOptions.create(BASE_URL)
PASSING = JobOptions.create(BASE_URL, passthrough_keys="Token, authorization,host,session")
FIRST_500 = JobOptions.create(BASE_URL, methods=["get"], path_prefixes=["/api"], max_records=500)
FIRST_1500 = dataclasses.replace(FIRST_500, max_records=1500)
PARTS = 4
WINDOW, WATERMARK = "6 hours", "1 hour"


def _filtered(options: JobOptions) -> Query:
    def run(spark, sf):
        return views.traffic(spark, sf).where(build_predicate(options)).select("line_no", "method", "path", "status")

    return run


def filter_custom(spark, sf):
    return _filtered(JobOptions.create(BASE_URL, extra_filters=[F.length("path") > 8]))(spark, sf)


def line_classes(spark, sf):
    return classify_lines(views.lines(spark, sf)).groupBy("line_class").agg(F.count("*").alias("n"))


def decoded_records(spark, sf):
    decoded = classify_lines(views.lines(spark, sf)).where("line_class = 'record'")
    return decoded.select("line_no", "method", "path", "query", "status")


def rejects(spark, sf):
    return rejected_lines(classify_lines(views.lines(spark, sf)))


def ingest_funnel(spark, sf):
    return jobs.funnel(views.lines(spark, sf), API_READS)


def ingest_funnel_max_records(spark, sf):
    return jobs.limited_funnel(views.lines(spark, sf), FIRST_500)


def _written_lines(spark, rows: DataFrame) -> str:
    """Rows as text files whose names follow ``line_no``."""
    path = views.scratch_dir(spark)
    parts = max(2, rows.rdd.getNumPartitions())
    rows.repartitionByRange(parts, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return path


def file_funnel(spark, sf):
    """Lines of files, some of which are not UTF-8 and some of which end with a carriage return."""
    bytes_ = F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\xff\xfe")))
    value = F.when(F.col("line_no") % 50 == 7, bytes_.cast("string"))
    value = value.when(F.col("line_no") % 50 == 8, F.concat("value", F.lit("\r"))).otherwise(F.col("value"))
    path = _written_lines(spark, views.lines(spark, sf).withColumn("value", value))
    options = JobOptions.create(BASE_URL, input_path=path, methods=["get"], path_prefixes=["/api"])
    return jobs.funnel(jobs.source_lines(spark, options), options)


def file_funnel_max_records(spark, sf):
    path = _written_lines(spark, views.lines(spark, sf))
    options = JobOptions.create(
        BASE_URL, input_path=path, methods=["get"], path_prefixes=["/api"], max_records=500
    )
    return jobs.funnel(jobs.source_lines(spark, options), options)


def query_redacted(spark, sf):
    query = redact_query(F.col("query"))
    kept = redact_query(F.col("query"), PASSING.passthrough)
    return views.traffic(spark, sf).select("line_no", query.alias("query"), kept.alias("query_token_kept"))


def page_queries(spark, sf):
    """Query strings of real page addresses, with a private parameter appended."""
    pages = views.table(spark, sf, "pages")
    query = F.concat(
        F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&Session=s"), F.col("page_id"), F.lit("&lang=x")
    )
    return pages.select("page_id", redact_query(query).alias("query"))


def request_urls(spark, sf):
    url = request_url(EVERYTHING.base_url, F.col("path"), redact_query(F.col("query")))
    return views.traffic(spark, sf).select("line_no", url.alias("url"))


def _header_rows(rows: DataFrame) -> DataFrame:
    names = rows.select("line_no", F.posexplode("headers").alias("pos", "name", "vals"))
    return names.select("line_no", "pos", "name", F.posexplode("vals").alias("vpos", "value"))


def header_values(spark, sf):
    return _header_rows(classify_lines(views.full_lines(spark, sf)).select("line_no", "headers"))


def headers_clean(spark, sf):
    decoded = classify_lines(views.full_lines(spark, sf))
    return _header_rows(decoded.select("line_no", clean_headers(F.col("headers")).alias("headers")))


def headers_clean_passthrough(spark, sf):
    decoded = classify_lines(views.full_lines(spark, sf))
    cleaned = clean_headers(F.col("headers"), PASSING.passthrough)
    return _header_rows(decoded.select("line_no", cleaned.alias("headers")))


def _bodies(spark, sf, passthrough=()):
    texts = views.records(spark, sf).where(~is_base64(F.col("body_encoding")) & F.col("body").isNotNull())
    return redact_bodies(texts, passthrough).select("line_no", "body_redacted", "body_unparsed")


def body_redacted(spark, sf):
    return _bodies(spark, sf)


def body_redacted_passthrough(spark, sf):
    return _bodies(spark, sf, PASSING.passthrough)


def document_bodies(spark, sf):
    """Whole document texts inside JSON bodies with a private field beside them."""
    documents = views.spread(views.table(spark, sf, "documents"))
    author = F.struct(F.concat(F.lit("a"), "doc_id").alias("Email"), F.col("lang"))
    body = F.to_json(F.struct("text", author.alias("author"), "doc_id"))
    rows = documents.select("doc_id", body.alias("body"), F.lit("application/json").alias("content_type"))
    return redact_bodies(rows).select("doc_id", F.md5("body_redacted").alias("body_md5"))


def body_decoded(spark, sf):
    coded = views.records(spark, sf).where(is_base64(F.col("body_encoding")))
    decoded = decode_base64(F.col("body"))
    return coded.select("line_no", decoded.cast("string").alias("body"), decoded.isNull().alias("rejected"))


def _request_columns(requests: DataFrame) -> DataFrame:
    values = F.transform(F.map_values("headers"), lambda v: F.array_join(v, "|"))
    return requests.select(
        *(c for c in requests.columns if c == "date"),
        "line_no",
        "method",
        "url",
        F.array_join(F.map_keys("headers"), ",").alias("header_names"),
        F.array_join(values, ";").alias("header_values"),
        F.col("body").cast("string").alias("body"),
        "content_type",
    )


def sanitized_requests(spark, sf):
    return _request_columns(jobs.sanitized_requests(views.full_lines(spark, sf), API_READS))


def extra_sanitizer(spark, sf):
    lower = dataclasses.replace(API_READS, extra_sanitizers=(lambda df: df.withColumn("url", F.lower("url")),))
    return jobs.sanitized_requests(views.full_lines(spark, sf), lower).select("line_no", "url")


def stored_requests(spark, sf):
    path = views.scratch_dir(spark)
    write_requests(jobs.sanitized_requests(views.full_lines(spark, sf), API_READS), path)
    return _request_columns(spark.read.parquet(path).withColumn("date", F.col("date").cast("string")))


def _flat_report(report: DataFrame) -> DataFrame:
    maps = ("status_distribution", "error_categories")
    flat = {
        name: F.array_join(
            F.transform(
                F.array_sort(F.map_entries(name)),
                lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
            ),
            ",",
        )
        for name in maps
    }
    return report.withColumns(flat)


def dry_run_stats(spark, sf):
    return _flat_report(jobs.dry_run_report(views.full_lines(spark, sf), API_READS))


def dry_run_outcomes(spark, sf):
    outcomes = jobs.dry_run_outcomes(views.full_lines(spark, sf), API_READS)
    return outcomes.select("line_no", "status", "latency_us", "error", "was_dry_run")


def invalid_method(spark, sf):
    named = F.when(F.col("line_no") % 10 == 3, F.lit("G T")).when(F.col("line_no") % 10 == 7, F.lit("")).when(
        F.col("line_no") % 10 == 8, F.lit("PROP*FIND")
    )
    rows = views.traffic(spark, sf).select("line_no", F.coalesce(named, "method").alias("method"))
    _, failed = jobs.known_failures(rows)
    return failed.select(
        "line_no", "status", "latency_us", stats.error_category(F.col("error")).alias("category"), "was_dry_run"
    )


def outcome_counts(spark, sf):
    return stats.outcome_counts(views.traffic(spark, sf))


def status_distribution(spark, sf):
    return stats.status_distribution(views.traffic(spark, sf))


def error_categories(spark, sf):
    return stats.error_distribution(views.traffic(spark, sf))


def latency_buckets(spark, sf):
    return stats.latency_histogram(views.traffic(spark, sf))


def latency_percentiles(spark, sf):
    return stats.histogram_percentiles(stats.latency_histogram(views.traffic(spark, sf)))


def latency_percentiles_by_method(spark, sf):
    histogram = stats.latency_histogram(views.traffic(spark, sf), "method")
    return stats.histogram_percentiles(histogram, "method")


_OUTCOME_COLUMNS = stats.REPORT_COLUMNS[3:]


def stats_report(spark, sf):
    return _flat_report(stats.stats_report(views.traffic(spark, sf))).select(*_OUTCOME_COLUMNS)


def stats_report_by_method(spark, sf):
    report = stats.stats_report(views.traffic(spark, sf), "method")
    return _flat_report(report).select("method", *_OUTCOME_COLUMNS)


def full_report(spark, sf):
    return _flat_report(jobs.replay_report(views.lines(spark, sf), views.traffic(spark, sf), API_READS))


def summary(spark, sf):
    report = jobs.replay_report(views.lines(spark, sf), views.traffic(spark, sf), API_READS)
    return summary_lines(report)


def stats_json(spark, sf):
    """The report as it reads back from its JSON."""
    report = jobs.replay_report(views.lines(spark, sf), views.traffic(spark, sf), API_READS)
    path = views.scratch_dir(spark)
    if not write_stats_json(report, path):
        raise ValueError("the report was not written")
    fields = ", ".join(f"{name} {kind.replace('map<int,', 'map<string,')}" for name, kind in report.dtypes)
    return _flat_report(spark.read.schema(fields).option("multiLine", "true").json(path))


def rate_over_cap(spark, sf):
    # The tables hold about one event every few minutes: an hour becomes a second.
    squeezed = F.timestamp_micros(F.expr("unix_micros(ts) div 3600"))
    over = rate_exceedance(views.traffic(spark, sf).withColumn("ts", squeezed), 10)
    return over.select(F.unix_micros("second").alias("second_us"), "requests", "excess")


def peak_requests_in_flight(spark, sf):
    peaks = peak_in_flight(views.traffic(spark, sf))
    return peaks.select(F.unix_micros("minute").alias("minute_us"), "peak")


def status_pairs(spark, sf):
    """Some requests were never replayed, some outcomes have no record."""
    sides = views.traffic(spark, sf)
    replayed = sides.where("line_no % 29 <> 0").select("line_no", F.col("replayed_status").alias("status"))
    return status_mismatch(sides.where("line_no % 23 <> 0"), replayed)


def replay_gaps(spark, sf):
    return replay_schedule(views.traffic(spark, sf), "user_id")


def stream_requests(spark, sf):
    base = views.scratch_dir(spark)
    source = _written_lines(spark, views.full_lines(spark, sf))
    query = start_request_stream(
        stream_lines(spark, source, max_files_per_trigger=4),
        API_READS,
        f"{base}/out",
        f"{base}/checkpoint",
        availableNow=True,
    )
    query.awaitTermination()
    stored = spark.read.parquet(f"{base}/out")
    return stored.select(
        "disposition", "method", "url", F.col("body").cast("string").alias("body"), "value"
    )


def stream_window_stats(spark, sf):
    base = views.scratch_dir(spark)
    rows = views.traffic(spark, sf).select("ts", "status", "latency_us", "error", "was_dry_run")
    rows.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    outcomes = stream_outcomes(spark, f"{base}/in", rows.schema, "ts")
    query = start_window_stats(
        outcomes, WINDOW, WATERMARK, f"{base}/out", f"{base}/checkpoint", availableNow=True
    )
    query.awaitTermination()
    report = window_report(spark.read.parquet(f"{base}/out"))
    return report.select(
        F.unix_micros("window_start").alias("window_start_us"),
        "attempted",
        "succeeded",
        "failed",
        "p50_us",
        "p95_us",
        "p99_us",
    )


def _in_parts(rows: DataFrame) -> DataFrame:
    """Every fourth line in one part, in order: a folder of a file each once written."""
    parted = rows.select("line_no", "value", (F.col("line_no") % PARTS).alias("part"))
    return parted.repartition(PARTS, "part").sortWithinPartitions("part", "line_no").drop("line_no")


def line_numbers(spark, sf):
    path = views.scratch_dir(spark)
    _in_parts(views.lines(spark, sf)).write.partitionBy("part").text(path)
    part = F.regexp_extract("line_no.file", r"part=(\d+)", 1).cast("long")
    return numbered_lines(spark, path).select(part.alias("part"), "line_no.row", "value")


def corrupt_files(spark, sf):
    """Packed files, one of which breaks off in its first bytes."""
    path = views.scratch_dir(spark)
    rows = _in_parts(views.lines(spark, sf))
    rows.where(F.col("part") != 2).write.partitionBy("part").option("compression", "gzip").text(path)
    views.write_torn(rows.where(F.col("part") == 2), f"{path}/part=2", 5)
    options = dataclasses.replace(API_READS, source_uri=path)
    return jobs.funnel(jobs.surviving_source(spark, options)[0], options)


def _by_time(rows: DataFrame, late: bool = False) -> list[DataFrame]:
    """Fifths of the time span; with ``late``, some rows of all of them come last."""
    micros = F.unix_micros("ts")
    first, last = rows.agg(F.min(micros), F.max(micros)).first()
    fifth = F.least(F.lit(4), F.expr(f"(unix_micros(ts) - {first}) * 5 div {last - first}"))
    chunk = F.when(F.col("line_no") % 10 == 0, 4).otherwise(fifth) if late else fifth
    return [rows.where(chunk == k) for k in range(5)]


def _outcome_batches(spark, sf, start, late: bool = False, again: bool = False) -> DataFrame:
    """What a stream stored that was stopped after each of five deliveries."""
    base = views.scratch_dir(spark)
    rows = views.traffic(spark, sf).select("line_no", "ts", "status", "latency_us", "error", "was_dry_run")
    for chunk in _by_time(rows, late):
        repeated = chunk.withColumns({"status": F.lit(500), "ts": F.col("ts") + F.expr("INTERVAL 1 MINUTE")})
        for delivered in [chunk, repeated] if again else [chunk]:
            delivered.write.mode("append").parquet(f"{base}/in")
            outcomes = stream_outcomes(spark, f"{base}/in", rows.schema, "line_no", "ts")
            start(outcomes, f"{base}/out", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_late_rows(spark, sf):
    landed = _outcome_batches(spark, sf, landing.start_landing, late=True)
    return landing.judged_arrivals(landed, WINDOW, WATERMARK).select("line_no", "verdict")


def stream_running_report(spark, sf):
    cells = _outcome_batches(spark, sf, landing.start_running_cells, late=True)
    return _flat_report(landing.running_report(cells)).select(*_OUTCOME_COLUMNS)


def stream_repeated_outcomes(spark, sf):
    def start(outcomes, *places, **trigger):
        return landing.start_landing(first_outcomes_of_stream(outcomes, WATERMARK), *places, **trigger)

    landed = _outcome_batches(spark, sf, start, again=True)
    return _flat_report(stats.stats_report(landed)).select(*_OUTCOME_COLUMNS)


def repeated_outcomes(spark, sf):
    rows = views.traffic(spark, sf).select("line_no", "ts", "status", "latency_us", "error", "was_dry_run")
    again = rows.withColumns({"status": F.lit(500), "ts": F.col("ts") + F.expr("INTERVAL 1 SECOND")})
    return _flat_report(stats.stats_report(first_outcomes(again.unionByName(rows)))).select(*_OUTCOME_COLUMNS)


def stream_limited(spark, sf):
    """The funnel of a limited stream that was stopped after each of five deliveries."""
    base = views.scratch_dir(spark)
    rows = views.lines(spark, sf)
    first, last = rows.agg(F.min("line_no"), F.max("line_no")).first()
    step = (last - first) // 5 + 1
    for low in range(first, last + 1, step):
        chunk = rows.where(F.col("line_no").between(low, low + step - 1))
        in_order = chunk.repartitionByRange(2, "line_no").sortWithinPartitions("line_no")
        in_order.select("value").write.mode("append").text(f"{base}/in")
        landing.run_limited_request_stream(
            spark, stream_lines(spark, f"{base}/in"), FIRST_1500, f"{base}/out", f"{base}/checkpoint", availableNow=True
        )
    kept, kind = landing.limited_lines(spark, f"{base}/out", FIRST_1500.max_records), F.col("disposition")
    return kept.agg(
        F.count("*").alias("total_lines"),
        F.count_if(kind == "blank").alias("blank_lines"),
        F.count_if(kind == "json_error").alias("json_errors"),
        F.count_if(kind == "filtered").alias("filtered_count"),
        F.count_if(kind.isin("request", "sanitize_error")).alias("dispatched"),
    )


def stream_status_pairs(spark, sf):
    """Recorded requests and their outcomes as two streams; a last pair far ahead moves the watermarks on."""
    base = views.scratch_dir(spark)
    rows = views.traffic(spark, sf)
    recorded = rows.where("line_no % 23 <> 0").select("line_no", "ts", "status")
    replayed = rows.where("line_no % 29 <> 0").select(
        "line_no", (F.col("ts") + F.expr("INTERVAL 10 SECONDS")).alias("ts"), F.col("replayed_status").alias("status")
    )
    end = rows.agg(F.lit(-1).cast("long").alias("line_no"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0).alias("status"))
    both = zip([*_by_time(recorded), end], [*_by_time(replayed), end], strict=True)
    for left, right in both:
        left.select(recorded.columns).write.mode("append").parquet(f"{base}/recorded")
        right.select(recorded.columns).write.mode("append").parquet(f"{base}/replayed")
        sides = (spark.readStream.schema(recorded.schema).parquet(f"{base}/{side}") for side in ("recorded", "replayed"))
        landing.start_status_pairs(*sides, f"{base}/out", f"{base}/checkpoint", "1 minute", "1 day", availableNow=True).awaitTermination()
    pairs = spark.read.parquet(f"{base}/out").where("coalesce(recorded_no, replayed_no) >= 0")
    return pair_counts(pairs)


def _seconds(spark, sf, start) -> DataFrame:
    """What a stream of requests stored that was stopped after each of five deliveries and one far ahead."""
    base = views.scratch_dir(spark)
    rows = views.traffic(spark, sf).select("line_no", "ts", "user_id", "latency_us")
    end = rows.agg(
        F.lit(-1).cast("long").alias("line_no"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"), F.lit(1).cast("long").alias("latency_us"),
    )
    for chunk in [*_by_time(rows), end]:
        chunk.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        start(source, f"{base}/out", f"{base}/checkpoint", WATERMARK, availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_peak_requests(spark, sf):
    peaks = peak_of_seconds(_seconds(spark, sf, start_seconds_in_flight))
    return peaks.select(F.unix_micros("minute").alias("minute_us"), "peak")


def stream_replay_gaps(spark, sf):
    def start(rows, *places, **trigger):
        return start_request_seconds(rows, "user_id", *places, **trigger)

    return schedule_of_seconds(_seconds(spark, sf, start), "user_id")


def rerun_requests(spark, sf):
    """Requests by date, the first date of which is written a second time."""
    path = views.scratch_dir(spark)
    requests = jobs.sanitized_requests(views.full_lines(spark, sf), API_READS)
    write_requests(requests, path)
    first = spark.read.parquet(path).agg(F.min("date")).first()[0]
    write_requests(requests.where(F.col("ts").cast("date") == F.lit(first)), path, mode="overwrite")
    return _request_columns(spark.read.parquet(path).withColumn("date", F.col("date").cast("string")))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "filter_method": _filtered(JobOptions.create(BASE_URL, methods=["get", "POST"])),
        "filter_path_prefix": _filtered(JobOptions.create(BASE_URL, path_prefixes=["/api", "/health"])),
        "filter_status": _filtered(JobOptions.create(BASE_URL, statuses=[200, 404, 0])),
        "filter_chain": _filtered(API_READS),
        "filter_custom": filter_custom,
    }
    for run in (
        line_classes,
        decoded_records,
        rejects,
        ingest_funnel,
        ingest_funnel_max_records,
        file_funnel,
        file_funnel_max_records,
        query_redacted,
        page_queries,
        request_urls,
        header_values,
        headers_clean,
        headers_clean_passthrough,
        body_redacted,
        body_redacted_passthrough,
        document_bodies,
        body_decoded,
        sanitized_requests,
        extra_sanitizer,
        stored_requests,
        dry_run_stats,
        dry_run_outcomes,
        invalid_method,
        outcome_counts,
        status_distribution,
        error_categories,
        latency_buckets,
        latency_percentiles,
        latency_percentiles_by_method,
        stats_report,
        stats_report_by_method,
        full_report,
        stats_json,
        summary,
        rate_over_cap,
        peak_requests_in_flight,
        status_pairs,
        replay_gaps,
        stream_requests,
        stream_window_stats,
        line_numbers,
        corrupt_files,
        repeated_outcomes,
        rerun_requests,
        stream_limited,
        stream_late_rows,
        stream_running_report,
        stream_repeated_outcomes,
        stream_status_pairs,
        stream_peak_requests,
        stream_replay_gaps,
    ):
        found[run.__name__] = run
    return found
