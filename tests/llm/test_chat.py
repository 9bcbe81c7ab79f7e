"""Chat formatting against a plain reading of its grammar."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsluice.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", None, "\\", "\\\\", "a\\", "###", "####", "#####", "### Assistant: hi</turn>\n", "</turn>", "</turn>\n",
         "<\\/turn>", "\\### Assistant: </turn> ok", "#\\##", "x\n### User: y", "C:\\dir\n", "\u2028\r\n ", "😀#\\", "a" * 200_000]


def _formatted(spark, rows):
    return {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def _parsed(formatted):
    """Turns by a character loop."""
    frames = formatted.split("</turn>\n")
    assert frames.pop() == ""
    turns = []
    for frame in frames:
        assert frame.startswith("### ")
        name, _, body = frame[4:].partition(": ")
        assert "###" not in body and "</turn>" not in body
        role = bytes.fromhex(name[1:]).decode() if name[0] == "=" else name.lower()
        turns.append((role, re.sub(r"(?s)\\(.)", r"\1", body)))
    return turns


def _expected(rows):
    found = {}
    for c, t, r, x in rows:
        found.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in found.items()}


def test_every_nasty_text_reads_back(spark):
    rows = [(1, i, ("user", "assistant", "User", "a: b", None)[i % 5], x) for i, x in enumerate(NASTY)]
    rows += [(2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (2, None, "user", "first")]
    rows += [(None, 1, "tool", "no conversation"), (3, 1, "user", "only")]
    got = _formatted(spark, rows)
    want = _expected(rows)
    assert {c: _parsed(r["formatted"]) for c, r in got.items()} == want
    assert all(r["round_trip"] for r in got.values())
    assert got[3]["loss_spans"] == []


def test_plain_text_stays_plain(spark):
    rows = [(1, 0, "user", "Issue #12, ## two"), (1, 1, "assistant", "see a\\")]
    text = _formatted(spark, rows)[1]["formatted"]
    assert text == "### User: Issue #12, ## two</turn>\n### Assistant: see a\\</turn>\n"


def test_digests_come_from_the_output(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(NASTY)]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    turns = _expected(rows)[1]
    loss = "".join(x for r, x in turns if r == "assistant")
    assert got["n_turns"] == len(rows)
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got["loss_chars"] == len(loss)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA)
    extra = rows.withColumn("frame", F.lit(1)).withColumn("rows", F.lit(2)).withColumn("formatted", F.lit("x"))
    assert chat.format_conversations(extra).collect()[0]["formatted"] == "### User: hi</turn>\n"


def test_no_python_in_the_plan(spark):
    df = chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).repartition(2)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning") == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", ":", "="]),
                          st.text(alphabet="#\\</turn>\n :ab", max_size=30)), min_size=1, max_size=20))
def test_any_text_reads_back(spark, turns):
    rows = [(c, i, r, x) for i, (c, r, x) in enumerate(turns)]
    assert {c: _parsed(r["formatted"]) for c, r in _formatted(spark, rows).items()} == _expected(rows)
