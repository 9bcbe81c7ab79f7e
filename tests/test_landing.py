"""Limits, late rows, running reports and pairs over several batches of a stream, with restarts."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logsluice import JobOptions
from logsluice.operators.compare import first_outcomes, first_outcomes_of_stream, pair_counts, status_mismatch
from logsluice.operators.stats import stats_report
from logsluice.plans.sinks import write_requests
from logsluice.sources.lines import stream_lines
from logsluice.sources.outcomes import stream_outcomes
from logsluice.streaming import landing

HIT = '{"method":"GET","path":"/v2/trees"}'
MISS = '{"method":"GET","path":"/v1/trees"}'
UNSENDABLE = '{"method":"PUT","path":"/v2/x","body":"?","body_encoding":"base64"}'
OUTCOME = "line_no long, ts timestamp, status int, latency_us long, error string, was_dry_run boolean"
REPORT = ("attempted", "succeeded", "failed", "status_distribution", "error_categories", "elapsed_secs", "throughput_rps", "p50_us", "p95_us", "p99_us")
START = datetime(2031, 5, 6, tzinfo=timezone.utc)


def _options(wanted):
    return JobOptions.create("http://h", path_prefixes=["/v2"], max_records=wanted)


def _read_upto(lines, wanted):
    passed = 0
    for n, line in enumerate(lines):
        passed += '"/v2' in line
        if passed == wanted:
            return lines[: n + 1]
    return lines


@pytest.mark.parametrize("wanted", [0, 55, 140, 10_000])
def test_a_limit_over_five_batches_and_a_restart(spark, tmp_path, wanted):
    rng = random.Random(wanted)
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    everything, reached = [], []
    try:
        for batch in range(5):
            for name in "ab":
                lines = [rng.choice([HIT, MISS, "", "broken", UNSENDABLE]) for _ in range(60)]
                (tmp_path / "in" / f"{batch}{name}.ndjson").write_text("\n".join(lines) + "\n")
                everything += lines
            source = stream_lines(spark, str(tmp_path / "in"))
            done = landing.run_limited_request_stream(
                spark, source, _options(wanted), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True
            )
            reached.append(done)
            if (tmp_path / "out").exists():
                kept = landing.limited_lines(spark, str(tmp_path / "out"), wanted).collect()
                want = _read_upto(everything, wanted) if wanted else []
                assert len(kept) == len(want)
                passed = [r for r in kept if r.disposition in ("request", "sanitize_error")]
                assert len(passed) == sum('"/v2' in x for x in want) and len(passed) <= wanted
                shown = {"request": HIT, "sanitize_error": UNSENDABLE, "blank": "", "json_error": "broken", "filtered": MISS}
                assert sorted(shown[r.disposition] for r in kept) == sorted(want)
        total = sum('"/v2' in x for x in everything)
        assert reached[-1] == (total >= wanted) and reached == sorted(reached)
        if wanted and reached[0]:
            # Nothing is read for a limit that was reached before.
            assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _rows(rng, n, spread=2000):
    errors = [None, None, "timed out", "tls", "odd"]
    return [
        (i, START + timedelta(seconds=rng.randint(0, spread), microseconds=rng.randint(0, 999_999)) if rng.random() < 0.97 else None,
         rng.choice([200, 204, 404, 503, None]), rng.choice([0, 1, 900, 5_000_000, 90_000_000]), rng.choice(errors), rng.random() < 0.1)
        for i in range(n)
    ]


def _deliver(spark, path, rows):
    spark.createDataFrame(rows, OUTCOME).repartition(3).write.mode("append").parquet(str(path))


def _stream(spark, path, **options):
    schema = spark.createDataFrame([], OUTCOME).schema
    return stream_outcomes(spark, str(path), schema, "line_no", "ts", **options)


def _forget_last_commit(checkpoint):
    """As if the driver had died after the last batch was written and before it was noted."""
    commits = sorted((f for f in Path(checkpoint, "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)


def test_late_rows_are_kept_and_counted_exactly(spark, tmp_path):
    rng = random.Random(7)
    batches = [_rows(rng, 80, spread) for spread in (300, 900, 200, 2500, 2500)]
    seen, want = None, []
    for rows in batches:
        mark = None if seen is None else seen - timedelta(seconds=90)
        for row in rows:
            end = None if row[1] is None else START + timedelta(minutes=2) * ((row[1] - START) // timedelta(minutes=2) + 1)
            want.append("untimed" if row[1] is None else "late" if mark is not None and end <= mark else "on_time")
        seen = max([seen or START, *(r[1] for r in rows if r[1])])
        _deliver(spark, tmp_path / "in", rows)
        landing.start_landing(_stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    _forget_last_commit(tmp_path / "cp")
    landing.start_landing(_stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    judged = landing.judged_arrivals(spark.read.parquet(str(tmp_path / "out")), "2 minutes", "90 seconds")
    got = {r.verdict: r["count"] for r in judged.groupBy("verdict").count().collect()}
    assert got == {v: want.count(v) for v in set(want)} and got["late"] > 20 and sum(got.values()) == 400
    on_time = stats_report(judged.where("verdict = 'on_time'").withColumn("start", F.col("window.start")), "start")
    assert on_time.agg(F.sum("attempted")).first()[0] == got["on_time"]


def test_a_running_report_equals_the_whole_one_after_every_batch(spark, tmp_path):
    rng, everything = random.Random(8), []

    def run():
        landing.start_running_cells(_stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
        got = landing.running_report(spark.read.parquet(str(tmp_path / "out"))).select(*REPORT).collect()
        want = stats_report(spark.createDataFrame(everything, OUTCOME)).select(*REPORT).collect()
        assert got == want

    for batch in range(5):
        rows = _rows(rng, 200) * (1 + batch % 2)
        everything += rows
        _deliver(spark, tmp_path / "in", rows)
        run()
        if batch in (1, 4):
            _forget_last_commit(tmp_path / "cp")
            run()
    cells = spark.read.parquet(str(tmp_path / "out"))
    assert cells.select("batch").distinct().count() == 5 and cells.count() < len(everything)
    landing.compact_cells(cells, str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert landing.running_report(compact).select(*REPORT).collect() == landing.running_report(cells).select(*REPORT).collect()
    assert compact.count() <= cells.count()


def test_tasks_merge_cells_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(landing, "HELD", 10)
    rows = _rows(random.Random(1), 300)
    frame = spark.createDataFrame(rows, OUTCOME)
    held = landing.cell_columns()
    cells = frame.select(*held, F.lit(1).cast("long").alias("n"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    merged = list(landing._merged(iter(cells.toArrow().to_batches(max_chunksize=7))))
    assert sum(sum(b.column("n").to_pylist()) for b in merged) == 300
    assert landing.running_report(spark.createDataFrame([r for b in merged for r in b.to_pylist()], landing.CELLS)).select(*REPORT[:3]).collect() == stats_report(frame).select(*REPORT[:3]).collect()


def test_an_outcome_delivered_again_counts_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for r in _rows(rng, 150) if r[1]]
    again = [(n, ts + timedelta(seconds=rng.randint(1, 30)), 500, 1, None, False) for n, ts, *_ in rows if rng.random() < 0.6]
    unknown = [(None, START, 200, 5, None, False)] * 3
    both = rows + again + unknown
    want = stats_report(spark.createDataFrame(rows + unknown, OUTCOME)).select(*REPORT).collect()
    assert stats_report(first_outcomes(spark.createDataFrame(both, OUTCOME).repartition(5))).select(*REPORT).collect() == want
    _deliver(spark, tmp_path / "in", rows + unknown)
    for part in (again[::2], again[1::2] + rows[:20]):
        out = first_outcomes_of_stream(_stream(spark, tmp_path / "in"), "1 hour")
        landing.start_landing(out, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
        _deliver(spark, tmp_path / "in", part)
    out = first_outcomes_of_stream(_stream(spark, tmp_path / "in"), "1 hour")
    landing.start_landing(out, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == len(rows) + 3 and stats_report(stored).select(*REPORT).collect() == want


def test_pairs_of_two_streams_equal_the_batch_join(spark, tmp_path):
    rng = random.Random(10)
    recorded = [r for r in _rows(rng, 300, 3000)]
    replayed = [(n if n % 7 else None if n % 2 else n + 10_000, ts and ts + timedelta(seconds=rng.randint(0, 100)), rng.choice([200, 503, None]), 5, None, False)
                for n, ts, *_ in recorded if n % 5]
    want = status_mismatch(
        spark.createDataFrame([r for r in recorded], OUTCOME).withColumn("line_no", F.when(F.col("ts").isNotNull(), F.col("line_no"))),
        spark.createDataFrame(replayed, OUTCOME).withColumn("line_no", F.when(F.col("ts").isNotNull(), F.col("line_no"))),
    )
    query = None
    for part in range(5):
        late = START + timedelta(seconds=600 * (part + 1))
        inside = lambda r: part == 0 if r[1] is None else late - timedelta(seconds=600) <= r[1] < late
        for name, rows in (("left", recorded), ("right", replayed)):
            mine = [r for r in rows if inside(r)] if part < 4 else [r for r in rows if r[1] and r[1] >= late - timedelta(seconds=600)]
            rng.shuffle(mine)
            _deliver(spark, tmp_path / name, mine)
        query = landing.start_status_pairs(
            _stream(spark, tmp_path / "left"), _stream(spark, tmp_path / "right"), str(tmp_path / "out"), str(tmp_path / "cp"),
            "2 minutes", "10 minutes", availableNow=True,
        )
        query.awaitTermination()
    # Rows far behind move the watermarks past all others.
    closing = [(99_999, START + timedelta(days=2), 200, 1, None, False)]
    for name in ("left", "right"):
        _deliver(spark, tmp_path / name, closing)
    query = landing.start_status_pairs(
        _stream(spark, tmp_path / "left"), _stream(spark, tmp_path / "right"), str(tmp_path / "out"), str(tmp_path / "cp"),
        "2 minutes", "10 minutes", availableNow=True,
    )
    query.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out")).where("recorded_no IS NULL OR recorded_no <> 99999")
    assert sorted(map(str, pair_counts(stored).collect())) == sorted(map(str, want.collect()))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_day_that_runs_again_leaves_the_others_alone(spark, tmp_path):
    path = tmp_path / "log"
    rows = [(i, START + timedelta(hours=5 * i) if i % 11 else None, "GET") for i in range(60)]
    requests = spark.createDataFrame(rows, "line_no long, ts timestamp, method string")
    write_requests(requests, str(path), max_rows=2)
    files = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    assert max(spark.read.parquet(str(f)).count() for f in files) <= 2
    before = sorted(map(tuple, spark.read.parquet(str(path)).collect()), key=str)
    day = START + timedelta(days=2)
    write_requests(requests.where((F.col("ts") >= F.lit(day)) & (F.col("ts") < F.lit(day + timedelta(days=1)))), str(path), mode="overwrite")
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    changed = {f.parent.name for f in set(files.items()) ^ set(after.items()) for f in [f[0]]}
    assert changed == {f"date={day.date()}"}
    assert sorted(map(tuple, spark.read.parquet(str(path)).collect()), key=str) == before
