"""The classifier against plain dictionaries, and its accuracy on documents it has not learned from."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from logsluice.llm import quality, queries
from logsluice.llm.words import text_bytes

SMALL = quality.Settings(bits=10, learners=2, epochs=2)


def _features(text):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array([text]))
    row, bucket, value = quality.features(data, offsets, SMALL)
    return dict(zip(bucket.tolist(), value.tolist(), strict=True))


def test_features_count_every_word_and_pair_of_a_text():
    assert _features("") == {} == _features(None)
    assert _features("The END") == _features("the\n\tend")
    one = _features("a b a b a b")
    assert math.isclose(sum(v * math.sqrt(11) for v in one.values()), 11)
    assert _features("word word word") == _features("word word  word")
    assert set(_features("x x")) & set(_features("y y y"))
    assert set(_features("ab%% c")) >= set(_features("ab")) | set(_features("%%"))


def test_ftrl_is_the_textbook_update():
    rng = random.Random(2)
    examples = [(np.array(sorted(rng.sample(range(8), 3))), np.array([rng.random() for _ in range(3)]), float(rng.random() < 0.5)) for _ in range(40)]
    s = quality.Settings(bits=3, epochs=1, alpha=0.3, beta=0.7, l1=0.05, l2=0.2)
    got, bias = quality._ftrl(examples, s)
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        l1, l2 = (0, 0) if i == 8 else (s.l1, s.l2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + l2)

    for bucket, value, label in examples:
        x = [*zip(bucket, value, strict=True), (8, 1.0)]
        w = {i: weight(i) for i, _ in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
        for i, v in x:
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g
    assert np.allclose([*got, bias], [weight(i) for i in range(9)])


def test_sample_is_bounded_and_leaves_conflicts_out(spark):
    rows = [(i, i % 2) for i in range(50)] + [(3, 0), (4, 0), (None, 1), (60, None), (61, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    everything = {r[0] for r in quality.labelled_sample(labels, quality.Settings()).collect()}
    assert everything == set(range(50)) - {3}
    assert quality.labelled_sample(labels, quality.Settings(examples=7)).count() == 7


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "x " * 300_000, None), (2, "ok", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels, SMALL)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scores = quality.score(docs, quality.train(docs, labels, SMALL)).select("score").collect()
    assert len(scores) == 4 and all(0 <= r[0] <= 1 for r in scores)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality_classifier(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n, right = got.join(labels, "doc_id").agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).collect()[0]
    assert n > 50 and right / n > 0.95
