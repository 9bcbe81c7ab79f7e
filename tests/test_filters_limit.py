import random

import pytest
from pyspark.sql import functions as F

from logsluice import JobOptions
from logsluice.operators import limit
from logsluice.operators.classify import classify_lines
from logsluice.operators.compare import status_mismatch
from logsluice.operators.filters import build_predicate, method_filter, path_prefix_filter, status_filter
from logsluice.plans import jobs, sinks
from logsluice.sources.lines import list_files, read_lines
from logsluice.sources.outcomes import read_outcomes

LIST_CARTS = '{"method":"GET","path":"/api/carts?","status":200}'
ADD_CART = (
    '{"method":"POST","path":"/api/carts","status":201,"content_type":"application/json",'
    '"body_encoding":"utf8","body":"{\\"size\\":3}"}'
)
OPEN_DOOR = '{"method":"GET","path":"/doors/7","status":200}'
NO_CART = '{"method":"GET","path":"/api/carts/0","status":404}'
BAD = "{method: GET}"
BAD_BASE64 = '{"method":"GET","path":"/api","body":"QQ","body_encoding":"base64"}'


def kept(spark, predicate, column, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"{column} {kind}")
    return [r[0] for r in df.where(predicate).collect()]


def test_method(spark):
    assert kept(spark, method_filter(["GET"]), "method", ["GET", "get", "Get", "POST"]) == ["GET", "get", "Get"]
    assert kept(spark, method_filter(["GET", "post"]), "method", ["GET", "POST", "DELETE"]) == ["GET", "POST"]


def test_path_prefix(spark):
    paths = ["/api", "/api/v1", "/apix", "/ap", "/API", "/a_i"]
    assert kept(spark, path_prefix_filter(["/api"]), "path", paths) == ["/api", "/api/v1", "/apix"]
    assert kept(spark, path_prefix_filter(["/a_", "/h%"]), "path", [*paths, "/hx"]) == ["/a_i"]
    assert kept(spark, path_prefix_filter([""]), "path", paths) == paths


def test_status(spark):
    values = [200, 201, 404, None, 0]
    assert kept(spark, status_filter([200, 201]), "status", values, "int") == [200, 201]
    assert kept(spark, status_filter([0]), "status", values, "int") == [None, 0]


def test_chain_is_a_conjunction_and_empty_passes(spark):
    rows = [("GET", "/api/v1", 200), ("POST", "/api/v1", 200), ("GET", "/x", 200), ("GET", "/api/v1", 404)]
    df = spark.createDataFrame(rows, "method string, path string, status int")
    chain = JobOptions.create("http://h", methods=["get"], path_prefixes=["/api"], statuses=[200])
    assert [tuple(r) for r in df.where(build_predicate(chain)).collect()] == rows[:1]
    assert df.where(build_predicate(JobOptions.create("http://h"))).count() == 4
    custom = JobOptions.create("http://h", extra_filters=[F.length("path") > 3])
    assert df.where(build_predicate(custom)).count() == 3


FUNNEL_CASES = [
    ([], {}, dict(total_lines=0, attempted=0)),
    (["\t", LIST_CARTS, ""], {}, dict(total_lines=3, parse_errors=0, attempted=1)),
    ([NO_CART, BAD, OPEN_DOOR, BAD, BAD], {}, dict(total_lines=5, parse_errors=3, filtered_count=0, attempted=2, succeeded=2)),
    ([NO_CART, LIST_CARTS, NO_CART], dict(statuses=[404]), dict(filtered_count=1, attempted=2)),
    ([ADD_CART, OPEN_DOOR, ADD_CART], dict(methods=["post"]), dict(filtered_count=1, attempted=2)),
    ([OPEN_DOOR, LIST_CARTS], dict(path_prefixes=["/doors", "/x"]), dict(filtered_count=1, attempted=1)),
    (
        [ADD_CART, LIST_CARTS, NO_CART, OPEN_DOOR],
        dict(methods=["GET"], path_prefixes=["/api"], statuses=[200]),
        dict(total_lines=4, filtered_count=3, attempted=1, succeeded=1),
    ),
    ([OPEN_DOOR, BAD] * 4, dict(max_records=3), dict(total_lines=5, parse_errors=2, attempted=3)),
    ([BAD_BASE64, LIST_CARTS], dict(max_records=1), dict(total_lines=1, parse_errors=1, attempted=0)),
    ([BAD, "", LIST_CARTS], dict(max_records=0), dict(total_lines=0, parse_errors=0, attempted=0)),
    ([LIST_CARTS, BAD], dict(max_records=9), dict(total_lines=2, parse_errors=1, attempted=1)),
]


@pytest.mark.parametrize("lines,options,expected", FUNNEL_CASES)
def test_dry_run_counters(spark, numbered, lines, options, expected):
    settings = JobOptions.create("http://h", **options)
    report = jobs.dry_run_report(limit.limit_lines(numbered(lines), settings), settings).first().asDict()
    assert {k: report[k] for k in expected} == expected
    assert report["attempted"] == report["succeeded"] + report["failed"]
    assert (report["p50_us"], report["status_distribution"], report["error_categories"]) == (0, {}, {})


def test_funnel_balances(spark, numbered):
    lines = [LIST_CARTS, BAD, "", b"\xff", OPEN_DOOR, BAD_BASE64]
    settings = JobOptions.create("http://h", path_prefixes=["/api"])
    f = jobs.funnel(numbered(lines), settings).first()
    assert f.total_lines == f.io_errors + f.blank_lines + f.json_errors + f.filtered_count + f.dispatched
    assert f.parse_errors == f.io_errors + f.json_errors + f.sanitize_errors == 3
    sent = jobs.dry_run_outcomes(numbered(lines), settings).collect()
    assert len(sent) == f.dispatched - f.sanitize_errors == 1
    assert (sent[0].status, sent[0].latency_us, sent[0].error, sent[0].was_dry_run) == (None, 0, None, True)


def plain_cut(lines, wanted, prefix="/api"):
    """Read line by line and stop: how many lines are read."""
    passed = read = 0
    for line in lines:
        if passed >= wanted:
            break
        read += 1
        passed += f'"path":"{prefix}' in line
    return read


@pytest.mark.parametrize("ranges", [1 << 9, 1 << 16])
def test_limit_matches_reading_in_order(spark, monkeypatch, ranges):
    monkeypatch.setattr(limit, "RANGES", ranges)
    monkeypatch.setattr(limit, "GROWTH", 1 << 12)
    rng = random.Random(ranges)
    lines = [rng.choice([LIST_CARTS, ADD_CART, OPEN_DOOR, BAD, "", BAD_BASE64]) for _ in range(60)]
    numbers = sorted(rng.sample(range(-(10**12), 10**12), 57)) + [10**15, 10**15 + 1, 10**18]
    df = spark.createDataFrame(list(zip(numbers, lines)), "line_no bigint, value string").repartition(5)
    for wanted in (1, 17, 500):
        settings = JobOptions.create("http://h", path_prefixes=["/api"], max_records=wanted)
        assert limit.limit_lines(df, settings).count() == plain_cut(lines, wanted)


@pytest.mark.parametrize("head", [4096, 7, 0])
def test_files_are_read_and_limited_in_order(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(limit, "HEAD_LINES", head)
    rng = random.Random(4)
    folder = tmp_path / "in put%20"
    folder.mkdir()
    lines = []
    for name in ("a.ndjson", "b.ndjson", "c.ndjson", "d.ndjson", "e.ndjson"):
        chunk = [rng.choice([LIST_CARTS, OPEN_DOOR, BAD, "", "\r"]) for _ in range(40)]
        (folder / name).write_bytes("".join(f"{c}\r\n" for c in chunk).encode())
        lines += chunk
    stored = read_lines(spark, str(folder))
    assert [r.value for r in stored.orderBy("line_no").collect()] == lines
    assert len(list_files(spark, str(folder))) == 5
    for wanted in (1, 9, 30, 10_000):
        settings = JobOptions.create(
            "http://h", input_path=str(folder), path_prefixes=["/api"], max_records=wanted
        )
        cut = limit.limit_source(spark, settings)
        read = plain_cut(lines, wanted)
        assert [r.value for r in cut.orderBy("line_no").collect()] == lines[:read]
    nothing = JobOptions.create("http://h", input_path=str(folder), max_records=0)
    assert limit.limit_source(spark, nothing).count() == 0


@pytest.fixture
def many_splits(spark, tmp_path):
    """One file of about 20 splits, and its lines."""
    rng = random.Random(5)
    lines = [rng.choice([LIST_CARTS, OPEN_DOOR, BAD]) + " " * rng.randrange(40) for _ in range(20_000)]
    (tmp_path / "one.ndjson").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    yield str(tmp_path / "one.ndjson"), lines
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_limit_inside_a_file_of_many_splits(spark, many_splits):
    path, lines = many_splits
    assert read_lines(spark, path).select("line_no.block").distinct().count() > 15
    for wanted in (1, 3_456, 6_000):
        settings = JobOptions.create("http://h", input_path=path, path_prefixes=["/api"], max_records=wanted)
        cut = limit.limit_source(spark, settings)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "130000")
        assert cut.count() == plain_cut(lines, wanted)
        assert [r.value for r in cut.orderBy("line_no").collect()] == lines[: plain_cut(lines, wanted)]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")


def test_a_small_limit_reads_a_few_splits(spark, many_splits):
    path, lines = many_splits
    settings = JobOptions.create("http://h", input_path=path, path_prefixes=["/api"], max_records=10)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small limit", "")
    cut = jobs.funnel(jobs.source_lines(spark, settings), settings)
    assert cut.first().total_lines == plain_cut(lines, 10)
    stages = [s for j in tracker.getJobIdsForGroup("small limit") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [info.numTasks for s in stages if (info := tracker.getStageInfo(s))]
    assert max(tasks) <= spark.sparkContext.defaultParallelism


def test_large_lines_do_not_come_to_the_driver(spark, tmp_path, monkeypatch):
    large = LIST_CARTS[:-1] + ',"extra":"' + "x" * 600_000 + '"}'
    lines = [BAD, *[large] * 11, OPEN_DOOR]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    (tmp_path / "b.ndjson").write_text("\n".join(lines))
    taken, take = [], type(spark.range(1)).take

    def counted(self, n):
        rows = take(self, n)
        taken.append(sum(len(v) for r in rows for v in r if isinstance(v, (str, bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(spark.range(1)), "take", counted)
    for wanted, bytes_taken in ((1, 700_000), (10, 0), (13, 2_000_000), (21, 0), (99, 0)):
        taken.clear()
        settings = JobOptions.create("http://h", input_path=str(tmp_path), path_prefixes=["/api"], max_records=wanted)
        cut = limit.limit_source(spark, settings)
        assert sum(taken) <= bytes_taken
        read = plain_cut(lines * 2, wanted)
        assert [r.value for r in cut.orderBy("line_no").collect()] == (lines * 2)[:read]


def test_names_are_no_patterns_and_hidden_files_are_refused(spark, tmp_path):
    for name in ("a[1].ndjson", "{b}.ndjson", "c*d?.ndjson", "plain.ndjson"):
        (tmp_path / name).write_text(f"{LIST_CARTS}\n{name}")
        assert sorted(r.value for r in read_lines(spark, str(tmp_path / name)).collect()) == sorted([LIST_CARTS, name])
        assert len(list_files(spark, str(tmp_path / name))) == 1
    for name in ("_x.ndjson", ".x"):
        (tmp_path / name).write_text(LIST_CARTS)
        with pytest.raises(ValueError):
            read_lines(spark, str(tmp_path / name))


def test_line_columns_are_filtered_before_decoding(spark, tmp_path, capsys):
    rows = [(i, LIST_CARTS, f"2025-01-0{i % 3 + 1}") for i in range(9)]
    spark.createDataFrame(rows, "line_no long, value string, day string").write.partitionBy("day").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    settings = JobOptions.create("http://h", methods=["get"])
    requests = jobs.sanitized_requests(table, settings, where=F.col("day") == "2025-01-02")
    requests.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(day" in plan and plan.count("from_json(") == 1
    assert requests.count() == 3


def test_stored_lines_keep_their_numbers(spark, many_splits, tmp_path):
    path, lines = many_splits
    sinks.write_lines(read_lines(spark, path), str(tmp_path / "stored"))
    stored = sinks.read_stored_lines(spark, str(tmp_path / "stored"))
    outcomes = jobs.dry_run_outcomes(stored, JobOptions.create("http://h"))
    sinks.write_outcomes(outcomes, str(tmp_path / "outcomes"), "line_no")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "130000")
    recorded = classify_lines(stored).where("line_class = 'record'")
    pairs = status_mismatch(recorded, read_outcomes(spark, str(tmp_path / "outcomes"), "line_no")).collect()
    assert {r.found_in for r in pairs} == {"both"} and sum(r.n for r in pairs) == sum(x[0:1] == '{' and "method:" not in x for x in lines)


def test_invalid_utf8_is_an_io_error(spark, tmp_path):
    (tmp_path / "x.ndjson").write_bytes(f"{LIST_CARTS}\n".encode() + b"\xff\xfe\n" + LIST_CARTS.encode())
    classes = classify_lines(read_lines(spark, str(tmp_path))).orderBy("line_no").select("line_class")
    assert [r[0] for r in classes.collect()] == ["record", "io_error", "record"]


def test_missing_source_fails(spark, tmp_path):
    settings = JobOptions.create("http://h", input_path=str(tmp_path / "none"))
    with pytest.raises(Exception):
        jobs.source_lines(spark, settings).count()


def test_a_filter_does_not_repeat_the_parse(spark, numbered, capsys):
    settings = JobOptions.create("http://h", methods=["get"], path_prefixes=["/a"], statuses=[200])
    jobs.sanitized_requests(numbered([LIST_CARTS]), settings).explain()
    assert capsys.readouterr().out.count("from_json(") == 1
