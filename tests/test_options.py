import pytest

from logsluice import JobOptions
from logsluice.operators.filters import describe_filters
from logsluice.options import parse_passthrough


def test_base_url_loses_all_trailing_slashes():
    assert JobOptions.create("http://h:1//").base_url == "http://h:1"
    assert JobOptions.create("/").base_url == ""


def test_empty_base_url_is_refused():
    with pytest.raises(ValueError):
        JobOptions.create("")


@pytest.mark.parametrize(
    "source",
    [
        {"input_path": "a", "s3_bucket": "b", "s3_key": "k"},
        {"input_path": "a", "s3_key": "k"},
        {"s3_bucket": "b"},
        {"s3_key": "k"},
    ],
)
def test_sources_exclude_each_other(source):
    with pytest.raises(ValueError):
        JobOptions.create("http://h", **source)


def test_source_uri():
    assert JobOptions.create("http://h", input_path="/a/b").require_source() == "/a/b"
    s3 = JobOptions.create("http://h", s3_bucket="b", s3_key="k/x.ndjson", region="eu-west-1")
    assert s3.require_source() == "s3a://b/k/x.ndjson"
    with pytest.raises(ValueError):
        JobOptions.create("http://h").require_source()


def test_passthrough_is_split_trimmed_and_lowered():
    assert parse_passthrough(" Key ,,SESSION_id") == {"key", "session_id"}
    assert parse_passthrough(None) == set()
    assert parse_passthrough("a, ") == {"a", ""}


@pytest.mark.parametrize("bad", [{"statuses": [70000]}, {"statuses": [-1]}, {"max_records": -1}])
def test_out_of_range_numbers_are_refused(bad):
    with pytest.raises(ValueError):
        JobOptions.create("http://h", **bad)


def test_filters_are_introspectable():
    assert not JobOptions.create("http://h").has_filters
    options = JobOptions.create("http://h", methods=["get"], path_prefixes=["/a"], statuses=[200])
    assert options.has_filters
    assert describe_filters(options) == ["method in GET", "path starts with /a", "status in 200"]
