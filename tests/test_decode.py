import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsluice.functions.decode import utc_timestamp
from logsluice.operators.classify import classify_lines, rejected_lines

GET = '{"method":"GET","path":"/a"}'


def classes(numbered, lines):
    rows = classify_lines(numbered(lines)).select("line_no", "line_class").collect()
    return [c for _, c in sorted(rows)]


def test_each_line_has_one_class(numbered):
    lines = [
        GET,
        "",
        "   ",
        "\u3000\u2003\x0b",
        f"\t {GET}\u00a0",
        b'{"method":"GET","path":"\xff\xfe"}',
        "not json",
        f"{GET} junk",
        f"{GET}{GET}",
        f"{GET},{GET}",
        f'{GET}],[{{"method":"x"}}',
        f"{GET},",
        f"\ufeff{GET}",
        "[]",
        "5",
        '"text"',
        "null",
        "{}",
        "{'method':'GET','path':'/a'}",
        '{"method":"GET","path":"/a","x":NaN}',
        '{"method":"GET","path":"/a","status":0123}',
        '{"method":"GET","path":"/a\tb"}',
    ]
    expected = ["record", "blank", "blank", "blank", "record", "io_error"] + ["json_error"] * 16
    assert classes(numbered, lines) == expected


def test_field_types(numbered):
    rejected = [
        '{"path":"/a"}',
        '{"method":"GET"}',
        '{"method":null,"path":"/a"}',
        '{"method":"GET","path":null}',
        '{"method":5,"path":"/a"}',
        '{"method":"GET","path":["/a"]}',
        '{"method":"GET","path":"/a","query":5}',
        '{"method":"GET","path":"/a","body":{}}',
        '{"method":"GET","path":"/a","timestamp":1}',
        '{"method":"GET","path":"/a","content_type":true}',
        '{"method":"GET","path":"/a","body_encoding":[]}',
        '{"method":"GET","path":"/a","status":"200"}',
        '{"method":"GET","path":"/a","status":200.0}',
        '{"method":"GET","path":"/a","status":2e2}',
        '{"method":"GET","path":"/a","status":70000}',
        '{"method":"GET","path":"/a","status":65536}',
        '{"method":"GET","path":"/a","status":-1}',
        '{"method":"GET","path":"/a","status":-0}',
        '{"status" : -0 , "method":"GET","path":"/a"}',
        '{"method":"GET","path":"/a","h\\u0065aders":5}',
        '{"method":"GET","path":"/a","status":99999999999999999999}',
        '{"method":"GET","path":"/a","headers":[]}',
        '{"method":"GET","path":"/a","headers":5}',
        '{"method":"GET","path":"/a","headers":"x"}',
    ]
    accepted = [
        '{"method":"GET","path":"/a","status":null,"query":null,"headers":null,"body":null}',
        '{"method":"GET","path":"/a","status":0}',
        '{"method":"GET","path":"/a","status":0,"body":"{\\"status\\":-0}"}',
        '{"method":"GET","path":"/a","h\\u0065aders":{"a":"b"}}',
        '{"method":"GET","path":"/a","status":65535}',
        '{"method":"","path":""}',
        '{"method":"GET","path":"/a","other":{"x":[1,2.5,null]}}',
        '{"method":"GET","path":"/a","other":1,"other":2}',
        '{ "path" : "/a" , "method" : "GET" }',
        '{"m\\u0065thod":"GET","path":"/a"}',
        '{"method":"GET","path":"/a","body":"\\"headers\\""}',
    ]
    assert set(classes(numbered, rejected)) == {"json_error"}
    assert set(classes(numbered, accepted)) == {"record"}


def test_full_record(numbered):
    line = json.dumps(
        {
            "timestamp": "2024-02-29T06:07:08Z",
            "method": "get",
            "path": "/é",
            "query": "?a=\n",
            "headers": {"Accept": "x"},
            "body": '{"a":"\\u0000"}',
            "body_encoding": "utf8",
            "content_type": "application/json",
            "status": 201,
        }
    )
    row = classify_lines(numbered([line])).first().asDict()
    assert row["method"] == "get" and row["path"] == "/é" and row["query"] == "?a=\n"
    assert row["headers"] == {"accept": ["x"]} and row["status"] == 201
    assert row["body"] == '{"a":"\\u0000"}' and row["timestamp"] == "2024-02-29T06:07:08Z"


def test_header_shapes(numbered):
    headers = [
        '{"z":"1","A":"x","b":["p",1,"q"],"C":3,"D":null,"a":"dup","e":{"k": 1},"f":true}',
        "{}",
        "null",
        '{"accept":"1","authorization":"2","x-b":"3","x-a":"4"}',
        '{"A":"1","A":"2","B":[],"a":["3",{}]}',
    ]
    lines = [f'{{"method":"GET","path":"/","headers":{h}}}' for h in headers] + [GET]
    entries = F.map_entries("headers").alias("entries")  # a collected map loses its order
    rows = sorted(classify_lines(numbered(lines)).select("line_no", entries).collect())
    got = [None if h is None else [tuple(e) for e in h] for _, h in rows]
    assert got[0] == [
        ("z", ["1"]),
        ("a", ["dup"]),
        ("b", ["p", "q"]),
        ("c", ["3"]),
        ("d", ["null"]),
        ("e", ['{"k":1}']),
        ("f", ["true"]),
    ]
    assert got[1] == [] and got[2] is None and got[5] is None
    assert [k for k, _ in got[3]] == ["accept", "authorization", "x-b", "x-a"]
    assert got[4] == [("a", ["3"]), ("b", [])]


def test_number_headers(numbered):
    line = '{"method":"GET","path":"/","headers":{"a":1.0,"b":3.10,"c":200,"d":0.5,"e":1e2,"f":-7}}'
    row = classify_lines(numbered([line])).select("headers").first()
    assert row[0] == {"a": ["1.0"], "b": ["3.1"], "c": ["200"], "d": ["0.5"], "e": ["100.0"], "f": ["-7"]}


def test_hostile_lines_do_not_stop_the_job(numbered):
    deep = "[" * 5000 + "]" * 5000
    lines = [
        '{"a":1},{"method":{"x":1}}] tail',
        '{"a":1},{"method":[1]}]',
        f'{{"method":"GET","path":"/","headers":{{"a":{deep}}}}}',
        f'{{"method":{deep},"path":"/"}}',
        deep,
        '{"method":"GET","path":"/","status":' + "9" * 400 + "}",
        "[" * 5000,
        '{"a' * 3000,
    ]
    assert set(classes(numbered, lines)) == {"json_error"}


def test_rejects_keep_their_text(numbered):
    rows = rejected_lines(classify_lines(numbered([GET, "bad", "", b"\xff"]))).collect()
    assert {(r.line_no, r.line_class) for r in rows} == {(1, "json_error"), (3, "io_error")}
    assert [r.value for r in rows if r.line_no == 1] == ["bad"]


def _plain_class(line):
    text = line.strip("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
    if not text:
        return "blank"
    try:
        record = json.loads(text, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return "json_error"
    if not isinstance(record, dict):
        return "json_error"
    texts = ("timestamp", "query", "body", "body_encoding", "content_type")
    fine = all(isinstance(record.get(k), str) for k in ("method", "path"))
    fine = fine and all(record.get(k) is None or isinstance(record[k], str) for k in texts)
    fine = fine and (record.get("headers") is None or isinstance(record["headers"], dict))
    status = record.get("status")
    fine = fine and (status is None or (type(status) is int and 0 <= status <= 65535))
    return "record" if fine else "json_error"


_values = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 80000), st.floats(allow_nan=False, allow_infinity=False, width=16),
    st.text(st.characters(exclude_categories=["Cs"]), max_size=5), st.just("GET"), st.just({}), st.just([1]),
)
_fields = st.sampled_from(
    ["method", "path", "query", "headers", "body", "status", "timestamp", "content_type", "body_encoding", "x"]
)
_records = st.dictionaries(_fields, _values, max_size=6).map(
    lambda d: json.dumps({"method": "GET", "path": "/p", **d}, ensure_ascii=False)
)
_lines = st.one_of(
    _records,
    st.tuples(_records, st.sampled_from([" ", "x", "{}", ",", "]", "\u2003", "}"])).map("".join),
    st.text(st.sampled_from('{}[]",: \t1a'), max_size=8),
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_lines, min_size=150, max_size=200))
def test_classes_agree_with_a_plain_parser(numbered, lines):
    assert classes(numbered, lines) == [_plain_class(line) for line in lines]


def test_times_without_a_zone_are_utc_in_any_session(spark):
    texts = {
        "2024-02-29T06:07:08": 1709186828, "2024-02-29 06:07:08.5": 1709186828.5, "2024-02-29": 1709164800,
        "2024-02-29T06:07:08Z": 1709186828, "2024-02-29T06:07:08+02:00": 1709179628, "2024-02-29T06:07:08 UTC": 1709186828,
        "no time": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "timestamp string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(F.unix_micros(utc_timestamp("timestamp")) / 1e6).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == list(texts.values())
