"""The model against a dictionary version of the same formulas."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from logsluice.llm import counted, kneser_ney, words
from logsluice.llm.shared_arrays import SharedArrays

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(60)]
TEXTS = [None, "", "The the\tTHE", "x" * 3000, "a " * 400, *(" ".join(RNG.choices(VOCABULARY, [1 / (i + 1) for i in range(60)], k=RNG.randint(1, 60))) for _ in range(80))]


def _tokens(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())] + ["</s>"]


class Brute:
    def __init__(self, texts):
        self.counts, self.pairs = Counter(), Counter()
        for t in map(_tokens, texts):
            self.counts.update(t)
            self.pairs.update(zip(["<s>", *t], t, strict=False))
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.before = Counter(w for _, w in self.pairs)
        self.after, self.kinds = Counter(), defaultdict(Counter)
        for (u, _), c in self.pairs.items():
            self.after[u] += c
            self.kinds[u][min(c, 3)] += 1
        self.d2, self.d1 = self._discounts(self.pairs), self._discounts(self.before)
        kinds = Counter(min(c, 3) for c in self.before.values())
        self.total = len(self.pairs)
        self.mass = sum(self.d1[k] * kinds[k] for k in (1, 2, 3)) / self.total

    def _discounts(self, counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2])
        raw = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2]]
        raw.append(3 - 4 * y * n[4] / n[3] if n[3] else raw[2])
        return [min(max(d, 0), c) for c, d in enumerate(raw)]

    def lower(self, w):
        c = self.before[w]
        return max(c - self.d1[min(c, 3)], 0) / self.total + self.mass / (self.v + 1)

    def probability(self, u, w):
        if not self.after[u]:
            return self.lower(w)
        c = self.pairs[u, w]
        back = sum(self.d2[k] * self.kinds[u][k] for k in (1, 2, 3))
        return (max(c - self.d2[min(c, 3)], 0) + back * self.lower(w)) / self.after[u]

    def score(self, text):
        t = _tokens(text)
        return sum(math.log10(self.probability(u, w)) for u, w in zip(["<s>", *t], t, strict=False))

    def base(self, text):
        return sum(math.log10((self.counts[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in _tokens(text))


@pytest.mark.parametrize("shard_bytes, held, hot", [(1 << 30, 1 << 21, 1000), (900, 40, 20), (900, 10, 1)])
def test_scores_equal_the_formulas(spark, tmp_path, monkeypatch, shard_bytes, held, hot):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(counted, "HELD", held)
    monkeypatch.setattr(kneser_ney, "HOT", hot)
    brute = Brute(TEXTS)
    file = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(file)
    model = kneser_ney.train(spark.read.parquet(file), f"file://{tmp_path}/model")
    assert (model.tokens, model.words, model.pairs) == (brute.n, brute.v, brute.total)
    assert (model.shards > 1) == (shard_bytes == 900)
    texts = [*TEXTS, "unknown w1 unknown words w2", "w0 w0 w1", "Ünknown"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for r in kneser_ney.score(docs.repartition(4), model).collect():
        text = texts[r["doc_id"]]
        t = _tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in brute.counts for w in t), brute.n)
        assert math.isclose(r["base_score"], brute.base(text), rel_tol=1e-9)
        assert math.isclose(r["score"], brute.score(text), rel_tol=1e-9), text


def test_probabilities_sum_to_one():
    brute = Brute(TEXTS)
    for u in ("<s>", "w0", "w3", "never seen"):
        assert math.isclose(sum(brute.probability(u, w) for w in [*brute.counts, "unknown"]), 1)


def test_nothing_to_learn_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = kneser_ney.train(docs.limit(0), f"file://{tmp_path}/none")
    got = kneser_ney.score(docs, model).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3] and all(r["score"] == 0 == r["n_known"] for r in got)
    only = kneser_ney.train(docs.where("doc_id is null"), f"file://{tmp_path}/one")
    assert all(r["score"] <= 0 for r in kneser_ney.score(docs, only).collect())


def test_counts_beyond_a_byte(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b " * 700)], "doc_id long, text string")
    model = kneser_ney.train(docs, f"file://{tmp_path}/m")
    arrays = SharedArrays(model.folder)
    large = [arrays.read(f"pair-large-{k}", "int64") for k in range(model.shards)]
    assert sorted(sum((x.reshape(2, -1)[1].tolist() for x in large), [])) == [699, 700]


def test_a_word_longer_than_a_block(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(words, "BLOCK", 8)
    texts = ["aa bb", "", "c" * 50, "d" * 9 + " e", "ff", " g  ", "h" * 8, "i i i i i i"]
    data, offsets = words.text_bytes(pa.array(texts))
    got = words.split_words(data, offsets)
    flat = [w for t in texts for w in t.split()]
    assert [data[a:b].tobytes().decode() for a, b in zip(got.starts, got.ends, strict=True)] == flat
    assert np.diff(got.first).tolist() == [len(t.split()) for t in texts]
    by_hash = dict(zip(got.hashes.tolist(), flat, strict=True))
    assert len(by_hash) == len(set(flat)) and all(by_hash[h] == w for h, w in zip(got.hashes.tolist(), flat, strict=True))
