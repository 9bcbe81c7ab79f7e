"""Quality scores of texts: hashed word n-gram logistic regression, trained by FTRL-proximal.

Words are runs of letters and digits or runs of other characters; a word that repeats the one
before it counts as a repeat mark. Features are the hashed words and word pairs of the whole
text, each with its count over the square root of all counts. Training sees a bounded sample of
labelled rows, dealt to a few learners whose weights are averaged; scores are sparse dot products
with the averaged weights, of a size that is fixed by the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.scale import quoted
from logsluice.llm.words import NOT_ALPHANUMERIC, WHITE_SPACE, ngrams, row_groups, split_words, text_bytes

_REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    """``examples``: the most labelled rows that training uses, lowest hash of their id first."""

    bits: int = 18
    order: int = 2
    examples: int = 20_000
    learners: int = 4
    epochs: int = 10
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


def _class_changes(lower: np.ndarray) -> np.ndarray:
    symbol, changes = NOT_ALPHANUMERIC[lower], np.zeros(len(lower), dtype=bool)
    changes[1:] = symbol[1:] != symbol[:-1]
    return changes


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature, in the order of rows and buckets."""
    words = split_words(data, offsets, WHITE_SPACE, _class_changes)
    rows = words.rows()
    repeats = np.zeros(len(rows), dtype=bool)
    repeats[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    words.hashes[repeats] = _REPEAT
    found = [ngrams(words, n) for n in range(1, settings.order + 1)]
    buckets = np.concatenate([(h >> np.uint64(64 - settings.bits)).astype(np.int64) for h, _ in found])
    keys = (np.concatenate([rows[at] for _, at in found]) << settings.bits) | buckets
    keys, counts = np.unique(keys, return_counts=True)
    row = keys >> settings.bits
    total = np.bincount(row, weights=counts, minlength=len(offsets) - 1)
    return row, keys & ((1 << settings.bits) - 1), counts / np.sqrt(total[row])


def labelled_sample(labels: DataFrame, settings: Settings, label: str = "quality", usable: Column | None = None) -> DataFrame:
    """At most ``examples`` rows of ``doc_id`` and ``label``; ids with null or conflicting labels are left out."""
    rows = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("labelled_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy("labelled_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return rows.where("label = most").orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(settings.examples).drop("most")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality", usable: Column | None = None) -> Model:  # noqa: B008
    """Learn ``label`` from the texts of ``docs``; ``usable`` may restrict ``labelled_id``.

    The sample has a fixed bound, so it is broadcast to the documents. With no labelled text the
    model scores everything 0.5. Of documents that share an id, one text is learned from.
    """
    sample = F.broadcast(labelled_sample(labels, settings, label, usable))
    texts = docs.select(F.col("doc_id").alias("labelled_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    examples = texts.join(sample, "labelled_id").groupBy("labelled_id", "label").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            learners, labels_of = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for lo, hi in row_groups(offsets):
                row, bucket, value = features(data, offsets[lo : hi + 1], settings)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                for i, a, b in zip(range(lo, hi), cuts, cuts[1:], strict=False):
                    held.setdefault(learners[i], []).append((bucket[a:b].astype(np.int32), value[a:b].copy(), labels_of[i]))
        for own in held.values():
            weights, bias = _ftrl(own, settings)
            at = np.flatnonzero(weights)
            columns = {"at": pa.array([at], pa.list_(pa.int64())), "weights": pa.array([weights[at]], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns | {"bias": [bias]})

    order = F.xxhash64("labelled_id")
    dealt = examples.select(F.pmod(order, F.lit(settings.learners)).cast("int").alias("learner"), F.col("label").cast("double"), "text", order.alias("order"), "labelled_id")
    dealt = dealt.repartitionById(settings.learners, F.col("learner")).sortWithinPartitions("learner", "order", "labelled_id")
    learned = dealt.select("learner", "label", "text").mapInArrow(learn, "at array<long>, weights array<double>, bias double").collect()
    total = np.zeros(1 << settings.bits)
    for r in learned:
        total[r["at"]] += r["weights"]
    n = max(1, len(learned))
    return Model(total / n, sum(r["bias"] for r in learned) / n, settings)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], s: Settings) -> tuple[np.ndarray, float]:
    """Follow the regularised leader; the last coordinate is the bias, which is not regularised."""
    n = 1 << s.bits
    z, squares = np.zeros(n + 1), np.zeros(n + 1)
    l1, l2 = np.full(n + 1, s.l1), np.full(n + 1, s.l2)
    l1[n] = l2[n] = 0

    def weights(f) -> np.ndarray:
        shrunk = np.sign(z[f]) * np.maximum(np.abs(z[f]) - l1[f], 0)
        return -shrunk / ((s.beta + np.sqrt(squares[f])) / s.alpha + l2[f])

    for _ in range(s.epochs):
        for bucket, value, label in examples:
            f, x = np.append(bucket, n), np.append(value, 1.0)
            w = weights(f)
            slope = (_logistic(w @ x) - label) * x
            grown = squares[f] + slope * slope
            z[f] += slope - (np.sqrt(grown) - np.sqrt(squares[f])) / s.alpha * w
            squares[f] = grown
    final = weights(slice(None))
    return final[:n], float(final[n])


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text; null is scored as empty."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    settings = model.settings
    names = [c for c in docs.columns if c != into]
    text_at = names.index("text")
    # Under names of their own, columns of any name can be sent to Python.
    sent_as = [f"c{k}" for k in range(len(names))]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            sums = np.zeros(batch.num_rows)
            for lo, hi in row_groups(offsets):
                row, bucket, value = features(data, offsets[lo : hi + 1], settings)
                sums[lo:hi] = np.bincount(row, weights=value * weights[bucket], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_logistic(sums + bias))], [*sent_as, "score"])

    kept = docs.select(*(quoted(c).alias(s) for c, s in zip(names, sent_as, strict=True)))
    schema = kept.withColumn("score", F.lit(0.0)).schema
    back = [F.col(s).alias(c) for c, s in zip([*names, into], [*sent_as, "score"], strict=True)]
    return kept.mapInArrow(rate, schema).select(*back)
