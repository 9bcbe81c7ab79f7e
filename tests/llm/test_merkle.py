"""The manifest against trees built from lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from logsluice.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _leaf(row):
    return _hash(*(_field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def _levels(nodes, arity):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([_hash(*made[-1][i : i + arity]) for i in range(0, len(made[-1]), arity)])
    return made


def _beside(levels, at, arity):
    for level in levels[:-1]:
        first = at - at % arity
        yield level[first:at], level[at + 1 : first + arity]
        at //= arity


def _expected(rows, arity=2):
    """One tuple per row: doc_id, leaf, subroot, root, proof, folded root."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, _leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels([m[2] for m in sorted(groups[g], key=lambda m: m[:3])], arity) for g in order}
    top = _levels([trees[g][-1][0] for g in order], arity)
    for place, g in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda m: m[:3])):
            way = [*_beside(trees[g], at, arity), *_beside(top, place, arity)]
            folded = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                folded = _leaf(row | {"n_chars": row["n_chars"] + 1})
            for left, right in way:
                folded = _hash(*left, folded, *right)
            yield row["doc_id"], leaf, trees[g][-1][0], top[-1][0], _hash(*(x for s in way for x in s[0] + s[1])), folded


def _rows():
    langs = [None, "", "en", "en", "en", "é", "z", "Z"]
    rows = [{"doc_id": i * 37 % 1009, "text": f"text {i}", "lang": langs[i % 8], "source": f"s{i % 3}", "n_chars": i} for i in range(1009)]
    rows[5] |= {"text": None, "n_chars": None}
    rows[6] |= {"text": "é😀" * 5000, "source": None}
    rows[7] |= {"doc_id": None}
    rows[8] |= {"doc_id": rows[9]["doc_id"], "lang": rows[9]["lang"]}
    rows += [rows[20], rows[20], rows[7], {"doc_id": 7, "text": "", "lang": "only", "source": "", "n_chars": 2**63 - 1}]
    return rows


def _documents(spark, rows, folder):
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    for name in ("leaf", "group", "place", "path", "size", "_tie"):
        frame = frame.withColumn(name, F.lit("theirs"))
    frame.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _got(frame):
    assert all(r.verified == (r.folded_root == r.root) for r in frame.collect())
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("levels", [2, 8])
def test_every_path_is_that_of_the_plain_tree(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = _rows()
    folder = _documents(spark, rows, tmp_path)
    assert _got(queries.op11_merkle_manifest(spark, folder)) == sorted(_expected(rows), key=repr)


def test_small_tables(spark, tmp_path):
    one = [{"doc_id": 1, "text": "a", "lang": "en", "source": "s", "n_chars": 1}]
    for name, rows in (("none", []), ("one", one), ("two", one + [one[0] | {"lang": None}])):
        folder = _documents(spark, rows, tmp_path / name)
        assert _got(queries.op11_merkle_manifest(spark, folder)) == sorted(_expected(rows), key=repr)


def test_wider_runs(spark):
    rows = _rows()[:300]
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    leaf = merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    found = merkle.manifest(frame, "lang", "doc_id", leaf, keep=("doc_id", "n_chars"), arity=3).rows
    got = found.select("row.doc_id", "leaf", "subroot", "root", merkle.node(merkle.siblings(F.col("path"))), merkle.fold(F.col("leaf"), F.col("path")))
    want = [(*w[:5], w[3]) for w in _expected(rows, arity=3)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
