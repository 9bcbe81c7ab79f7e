"""The pipeline's stages on a small corpus, against brute force."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from logsluice.llm import quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def linked_groups(texts, words, percent):
    """Groups of ids by the comparison of every pair; a text without words is alone."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < words else set(zip(*(w[k:] for k in range(words)), strict=False))
    groups = {i: {i} for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                joined = groups[a] | groups[b]
                for i in joined:
                    groups[i] = joined
    return {frozenset(g) for g in groups.values()}


def windows_removed(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    windows = Counter(r[k : k + length] for r in raw.values() for k in range(len(r) - length + 1))
    found = {}
    for i, r in raw.items():
        gone = {k + j for k in range(len(r) - length + 1) if windows[r[k : k + length]] > 1 for j in range(length)}
        found[i] = bytes(b for k, b in enumerate(r) if k not in gone).decode()
    return found


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(13)
    passage, base = _prose(rng, 80), _prose(rng, 120)
    texts = [_prose(rng, rng.randint(40, 200)) for _ in range(40)]
    texts += [_prose(rng, 30) + " " + passage + " " + _prose(rng, 30) for _ in range(5)]
    texts += [base, base, base + " tail", base.upper(), None, ""]
    texts += ["Buy " * rng.randint(60, 90) + "now%%% " * 30 for _ in range(12)]
    folder = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i < len(texts) - 12), 0) for i in range(len(texts)) if i % 3 and texts[i]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), {i: t for i, t in enumerate(texts)}


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]

    good = stages["quality_classifier"](spark, docs, folder)
    assert good.schema == docs.schema
    model = queries.quality_model(spark, folder)
    wanted = {r["doc_id"] for r in quality.score(docs, model).where(F.col("score") >= queries.GOOD).collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(kept) == wanted and all(kept[i] == texts[i] for i in kept)
    junk = set(list(texts)[-12:])
    assert not junk & wanted and len(wanted) >= len(texts) - 14

    one = stages["ngram_jaccard_join"](spark, docs, folder)
    assert one.schema == docs.schema
    groups = linked_groups(texts, words=3, percent=90)
    assert {r["doc_id"] for r in one.collect()} == {min(g) for g in groups}

    cut = stages["suffix_array_dedup"](spark, docs, folder)
    assert cut.schema == docs.schema
    left = windows_removed(texts, 200)
    for r in cut.collect():
        text = left[r["doc_id"]]
        assert (r["text"] or "") == text and r["n_chars"] in (len(text), None)

    packed = stages["best_fit_packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    total = Counter()
    for r in packed:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 4096


def test_near_copies_between_the_thresholds_are_one_document(spark):
    rng = random.Random(29)
    base, other, third, fourth = (_prose(rng, n) for n in (200, 180, 240, 200))
    texts = [base, base + " " + _prose(rng, 30), other + " " + _prose(rng, 40), other]
    words = third.split()
    texts += [third, " ".join(words[:100] + _prose(rng, 18).split() + words[118:])]
    words = fourth.split()
    texts += [fourth, " ".join("edited" if k in (40, 80, 120, 160) else w for k, w in enumerate(words))]
    texts += [base + " " + _prose(rng, 60), _prose(rng, 150)]
    texts = dict(enumerate(texts))
    wanted = {min(g) for g in linked_groups(texts, words=5, percent=80)}
    assert wanted == {0, 2, 4, 6, 8, 9} and {min(g) for g in linked_groups(texts, words=3, percent=90)} == set(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA).repartition(3)
    one = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {i: texts[i] for i in wanted}


def test_run_goes_through_all_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{hashlib.md5(name.encode()).hexdigest()}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    want = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in docs.collect())
    got = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and got


CLASHING = ("_component", "_again", "_score", "score", "kept", "_kept", "N_BYTES", "n_removed", "c0", "key", "row", "set", "component", "times", "a b", "x.y")


def test_names_of_the_caller_s_columns_meet_none_of_the_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs
    for name in CLASHING:
        wide = wide.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, folder)
        assert got.schema == wide.schema, name
        rows = got.collect()
        assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)
        plain = {(r.doc_id, r.text) for r in stage(spark, docs, folder).collect()}
        assert {(r.doc_id, r.text) for r in rows} == plain and len(rows) == len(plain)
    name, stage = corpus_pipeline.STAGES[-1]
    assert sorted(map(tuple, stage(spark, wide, folder).collect())) == sorted(map(tuple, stage(spark, docs, folder).collect()))


def test_texts_of_one_id_and_rows_without_one_stay_unless_they_are_copies(spark):
    rng = random.Random(31)
    a, b, c, d, e = (_prose(rng, 60) for _ in range(5))
    rows = [(5, a), (5, b), (5, a), (6, c), (None, d), (None, e), (7, d), (8, None), (8, ""), (8, " \n"), (None, None), (6, c.upper()), (9, b + " more"), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(4)
    one = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "")
    kept = Counter((r.doc_id, r.text) for r in one.collect())
    # Of c and its other case, which are one document, the hash of the text chooses.
    of_c = {k: n for k, n in kept.items() if k[0] == 6}
    assert list(of_c.values()) == [1] and set(of_c) <= {(6, c), (6, c.upper())}
    rest = kept - Counter(of_c)
    assert rest == Counter([(5, a), (5, b), (None, e), (7, d), (8, None), (8, ""), (8, " \n"), (None, None)])


def test_stages_of_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
