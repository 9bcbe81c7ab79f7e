"""Positions that come from the files alone, limits inside large files, files that cannot be read."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from logsluice import JobOptions
from logsluice.operators import limit
from logsluice.operators.classify import classify_lines
from logsluice.operators.compare import status_mismatch
from logsluice.plans import jobs, sinks
from logsluice.sources.lines import numbered_lines, read_lines, split_lines
from logsluice.sources.outcomes import read_outcomes

SHOW_BIKE = '{"method":"GET","path":"/bikes/7","status":200}'
SELL_BIKE = '{"method":"POST","path":"/bikes","status":201}'
SHOW_SHOP = '{"method":"GET","path":"/shop","status":200}'
TORN = '{"method":"GET",'
SPLITS = ("20000", "77777", "134217728")


@pytest.fixture
def splits(spark):
    """Set the size of splits; given back as it was."""
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _lines(rng, n):
    return [rng.choice([SHOW_BIKE, SELL_BIKE, SHOW_SHOP, TORN, "", " \r"]) + " " * rng.randrange(30) for _ in range(n)]


@pytest.fixture
def folder(tmp_path):
    """Files of several sizes, one packed, one ending without a line break, one empty."""
    rng = random.Random(12)
    held = {f"{k}.ndjson": _lines(rng, n) for k, n in (("a", 2000), ("b", 3), ("c", 4500), ("d", 0), ("e f%", 300))}
    held["g.ndjson.gz"] = _lines(rng, 1200)
    path = tmp_path / "in"
    path.mkdir()
    for name, lines in held.items():
        data = "".join(f"{x}\n" for x in lines).encode()[: -1 if name == "c.ndjson" else None]
        (path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return path, held


def test_line_numbers_come_from_the_file_alone(spark, folder, splits):
    path, held = folder
    want = sorted((name, i, line.removesuffix("\r")) for name, lines in held.items() for i, line in enumerate(lines))
    parallel = spark.sparkContext.defaultParallelism
    try:
        for size, cores in zip(SPLITS, (1, 3, parallel), strict=True):
            splits(size)
            spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
            got = numbered_lines(spark, str(path)).select(F.substring_index("line_no.file", "/", -1), "line_no.row", "value")
            assert sorted((f.replace("%20", " ").replace("%25", "%"), r, v) for f, r, v in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_stored_outcomes_join_the_files_read_again(spark, folder, splits, tmp_path):
    path, held = folder
    options = JobOptions.create("http://h", input_path=str(path), path_prefixes=["/bikes"])
    splits(SPLITS[0])
    outcomes = jobs.dry_run_outcomes(jobs.numbered_source(spark, options), options)
    sinks.write_outcomes(outcomes.withColumn("status", F.lit(200)), str(tmp_path / "outcomes"), "line_no")
    splits(SPLITS[1])
    again = classify_lines(jobs.numbered_source(spark, options)).where("path like '/bikes%'")
    pairs = status_mismatch(again, read_outcomes(spark, str(tmp_path / "outcomes"), "line_no")).collect()
    counts = {(r.recorded_status, r.found_in): r.n for r in pairs}
    every = [x.split("}")[0] + "}" for lines in held.values() for x in lines]
    assert counts == {(200, "both"): every.count(SHOW_BIKE), (201, "both"): every.count(SELL_BIKE)}


def test_lines_are_not_shuffled_to_be_numbered(spark, folder, capsys):
    numbered_lines(spark, str(folder[0])).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 2


def _cut(lines, wanted):
    passed = 0
    for n, line in enumerate(lines):
        passed += '"/bikes' in line
        if passed == wanted:
            return lines[: n + 1]
    return lines


@pytest.mark.parametrize("wanted", [1, 1500, 2500])
def test_a_cut_is_the_same_whatever_the_splits(spark, folder, splits, monkeypatch, wanted):
    monkeypatch.setattr(limit, "HEAD_LINES", 0)
    path, held = folder
    options = JobOptions.create("http://h", input_path=str(path), path_prefixes=["/bikes"], max_records=wanted)
    want = _cut([x.removesuffix("\r") for name in sorted(held) for x in held[name]], wanted)
    for found, read in ((0, 1), (1, 0)):
        splits(SPLITS[found])
        lines = limit.limit_source(spark, options)
        splits(SPLITS[read])
        assert [r.value for r in lines.orderBy("line_no").collect()] == want


def test_a_large_limit_decodes_few_splits_and_stores_nothing(spark, tmp_path, splits, monkeypatch):
    rng = random.Random(2)
    lines = [rng.choice([SHOW_BIKE, SHOW_SHOP]) + " " * rng.randrange(200) for _ in range(100_000)]
    file = tmp_path / "one.ndjson"
    file.write_text("\n".join(lines))
    splits(str(file.stat().st_size // 50 + 1))
    options = JobOptions.create("http://h", input_path=str(file), path_prefixes=["/bikes"], max_records=2500)
    monkeypatch.setattr(limit, "HEAD_LINES", 0)
    want = _cut(lines, 2500)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("large limit", "")
    cut, _ = limit.cut_in_file(split_lines(spark, str(file)), options, 2500)
    jobs_run = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("large limit")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert cut.lines == len(want) and 0 < cut.end <= file.stat().st_size * 0.08
    # Splits are taken 1, 4, 16 at a time: of 50, most are never decoded.
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs_run for s in j.stageIds]
    assert max(tasks) < 25 and len(tasks) < 8
    monkeypatch.setattr(type(spark.range(1).write), "parquet", None)
    kept = limit.limit_source(spark, options)
    assert kept.where(F.col("value").isNotNull()).count() == len(want)
    funnel = jobs.funnel(kept, options).first()
    assert (funnel.dispatched, funnel.total_lines) == (2500, len(want))


@pytest.fixture
def torn_folder(folder):
    """The folder with three files that cannot be read: cut off early, cut off late, and not packed at all."""
    path, held = folder
    packed = gzip.compress("".join(f"{x}\n" for x in _lines(random.Random(3), 20_000)).encode())
    (path / "b2.ndjson.gz").write_bytes(packed[:5])
    (path / "d2.ndjson.gz").write_bytes(packed[: len(packed) // 2])
    (path / "h [x] y.ndjson.gz").write_bytes(b"plain text\n" * 3)
    return path, held


def _plain(held):
    lines = [x.removesuffix("\r") for name in sorted(held) for x in held[name]]
    return len(lines), sum(x.startswith(TORN) and "path" not in x for x in lines), sum('"/bikes' in x for x in lines)


def test_files_that_cannot_be_read_are_named_and_the_others_counted(spark, torn_folder):
    path, held = torn_folder
    options = JobOptions.create("http://h", input_path=str(path), path_prefixes=["/bikes"])
    lines, table = jobs.surviving_source(spark, options)
    assert sorted(r.file.rpartition("/")[2] for r in table.collect()) == ["b2.ndjson.gz", "d2.ndjson.gz", "h%20%5Bx%5D%20y.ndjson.gz"]
    assert all(r.error for r in table.collect())
    n, torn, bikes = _plain(held)
    good = lines.where(~F.col("line_no.file").rlike(r"/(b2|d2|h%20)"))
    funnel = jobs.funnel(good, options).first()
    assert (funnel.total_lines, funnel.json_errors, funnel.dispatched, funnel.io_errors) == (n, torn, bikes, 0)
    whole = jobs.funnel(lines, options).first()
    assert whole.io_errors == 3 and whole.total_lines >= n + 3
    with pytest.raises(Exception, match="(?i)read"):
        jobs.funnel(read_lines(spark, str(path)), options).collect()


def test_sound_files_are_read_once_and_nothing_is_set_apart(spark, folder):
    path, held = folder
    lines, table = jobs.surviving_source(spark, JobOptions.create("http://h", input_path=str(path)))
    assert table.count() == 0 and lines.count() == sum(map(len, held.values()))


def test_a_limit_passes_by_files_that_cannot_be_read(spark, torn_folder, monkeypatch):
    path, held = torn_folder
    names = ["a.ndjson", "b.ndjson"]
    early = _plain({k: held[k] for k in names})[2]
    options = JobOptions.create("http://h", input_path=str(path), path_prefixes=["/bikes"], max_records=early + 5)
    lines, _ = jobs.surviving_source(spark, options)
    funnel = jobs.funnel(lines, options).first()
    want = _cut([x for k in (*names, "c.ndjson") for x in held[k]], early + 5)
    assert (funnel.dispatched, funnel.io_errors, funnel.total_lines) == (early + 5, 1, len(want) + 1)


def test_errors_that_are_no_file_s_fault_are_raised(spark, folder, monkeypatch):
    def broken(*_, **__):
        return spark.range(3).where(F.raise_error(F.lit("not a file")).isNull())

    monkeypatch.setattr("logsluice.sources.unreadable.read_lines", broken)
    with pytest.raises(Exception, match="not a file"):
        jobs.surviving_source(spark, JobOptions.create("http://h", input_path=str(folder[0])))
