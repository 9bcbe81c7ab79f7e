"""Interpolated modified Kneser-Ney model of word pairs, counted by Spark and scored from sorted arrays.

Three shuffles build it, each of arrays that a task has already counted and sorted: words by
ranges of their 64-bit hashes, pairs of word numbers by the first word, numbers of different
predecessors by ranges of the second word. The reducing tasks write sorted arrays to the shared
folder; later tasks memory-map them. A word that makes up a thousandth of all words has its pairs
dealt by the whole pair, so no task gets all of them. Shards grow in number with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.counted import SLICE, counting, dealt, hash_shard, packed, slice_schema, sums_by_shard
from logsluice.llm.scale import parts, shared_folder
from logsluice.llm.shared_arrays import SharedArrays
from logsluice.llm.words import mix, row_groups, split_words, text_bytes

SHARD_BYTES = 8 << 20
#: A word with at least this part of all tokens has its pairs dealt by the whole pair.
HOT = 1000
END = np.uint64(0xFFFFFFFFFFFFFFFF)

def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of the counts 0, 1, 2, and 3 or more, from how many counts are 1 to 4.

    Where these numbers are too small for the formula, a discount is half a count, and none
    exceeds its count.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    found = [0.0, 0.5, 0.5, 0.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        found[1] = 1 - 2 * y * n2 / n1
        found[2] = 2 - 3 * y * n3 / n2
        found[3] = 3 - 4 * y * n4 / n3 if n3 else found[2]
    return np.clip(found, 0, [0, 1, 2, 3])


@dataclass(frozen=True)
class Model:
    """What every task needs besides the mapped arrays; its size grows with the number of shards."""

    folder: str
    shards: int
    bases: tuple[int, ...]  # of the words' numbers, by shard, and the number of words
    tokens: int
    texts: int
    hot: tuple[int, ...] = ()
    hot_contexts: tuple[tuple[int, int, int], ...] = ()  # different pairs with count 1, 2, 3 or more
    pair_discounts: tuple[float, ...] = ()
    word_discounts: tuple[float, ...] = ()
    pairs: int = 0
    base_mass: float = 1.0  # of the uniform distribution under the words' own

    @property
    def words(self) -> int:
        return self.bases[-1]


class Reader:
    """The arrays of a model, mapped once in a worker."""

    def __init__(self, model: Model):
        self.model, self._arrays, self._open = model, SharedArrays(model.folder), {}
        self._hot = np.array(model.hot, dtype=np.int64)

    def _array(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            self._open[name] = self._arrays.read(name, dtype)
        return self._open[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct word hashes; -1 where the word is unknown."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        shards = hash_shard(hashes, self.model.shards)
        for k in np.unique(shards).tolist():
            a, b = np.searchsorted(shards, [k, k + 1])
            base, end = self.model.bases[k : k + 2]
            if base == end:
                continue
            known = self._array(f"words-{k}", np.uint64)
            place = np.searchsorted(known, hashes[a:b])
            place[place == len(known)] = 0
            found[a:b] = np.where(known[place] == hashes[a:b], base + place, -1)
        return found

    def _by_number(self, name: str, numbers: np.ndarray) -> np.ndarray:
        found = np.zeros(len(numbers), dtype=np.int64)
        shard = np.searchsorted(self.model.bases, numbers, side="right") - 1
        for k in np.unique(shard[numbers >= 0]).tolist():
            own = (shard == k) & (numbers >= 0)
            found[own] = self._array(f"{name}-{k}", np.uint32)[numbers[own] - self.model.bases[k]]
        return found

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Tokens of each word; 0 for -1."""
        return self._by_number("counts", numbers)

    def predecessors(self, numbers: np.ndarray) -> np.ndarray:
        """Different words before each word; 0 for -1."""
        return self._by_number("before", numbers)

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        first = keys // np.uint64(self.model.words + 1)
        hot = np.isin(first, self._hot.astype(np.uint64))
        return (mix(np.where(hot, keys, first)) % np.uint64(self.model.shards)).astype(np.int64)

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs; 0 where a pair is unknown."""
        found = np.zeros(len(keys), dtype=np.int64)
        shards = self.pair_shard(keys)
        for k in np.unique(shards).tolist():
            own = np.flatnonzero(shards == k)
            known = self._array(f"pairs-{k}", np.uint64)
            if not len(known):
                continue
            place = np.searchsorted(known, keys[own])
            place[place == len(known)] = 0
            hit = known[place] == keys[own]
            counts = self._array(f"pair-counts-{k}", np.uint8)[place].astype(np.int64)
            large = np.flatnonzero(hit & (counts == 255))
            if len(large):
                at, many = self._array(f"pair-large-{k}", np.int64).reshape(2, -1)
                counts[large] = many[np.searchsorted(at, place[large])]
            found[own] = np.where(hit, counts, 0)
        return found

    def contexts(self, first: np.ndarray) -> np.ndarray:
        """For each word, how many different pairs start with it that count 1, 2, 3 or more."""
        found = np.zeros((len(first), 3), dtype=np.int64)
        hot = np.isin(first, self._hot)
        if len(self._hot):
            found[hot] = np.array(self.model.hot_contexts, dtype=np.int64)[np.searchsorted(self._hot, first[hot])]
        shards = (mix(first.astype(np.uint64)) % np.uint64(self.model.shards)).astype(np.int64)
        for k in np.unique(shards[~hot]).tolist():
            own = (shards == k) & ~hot
            known = self._array(f"contexts-{k}", np.uint32).reshape(4, -1)
            found[own] = known[1:, np.searchsorted(known[0], first[own])].T
        return found


@lru_cache(maxsize=2)
def _reader(model: Model) -> Reader:
    return Reader(model)


def _sequences(data: np.ndarray, offsets: np.ndarray, reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, predecessor and token of each token, as word numbers; a start has the number after the last."""
    words = split_words(data, offsets)
    distinct, each = np.unique(words.hashes, return_inverse=True)
    both = reader.numbers(np.append(distinct, END))
    numbers, end = both[:-1][each], both[-1]
    n = len(offsets) - 1
    at = words.first + np.arange(n + 1)
    tokens = np.empty(len(numbers) + n, dtype=np.int64)
    is_end = np.zeros(len(tokens), dtype=bool)
    is_end[at[1:] - 1] = True
    tokens[is_end], tokens[~is_end] = end, numbers
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = tokens[:-1]
    before[at[:-1]] = reader.model.words
    return np.repeat(np.arange(n), np.diff(at)), before, tokens


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.append(split_words(data, offsets).hashes, np.full(len(offsets) - 1, END))


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Count words and pairs of all ``text`` and write the model's arrays.

    A null text is empty: its only token is the end. The arrays stay in ``folder``, by default
    a new one in the shared folder, for as long as the model is to be used.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "kneser-ney")
    shards = parts(docs, SHARD_BYTES)
    arrays = SharedArrays(folder)
    texts = docs.select(F.col("text").cast("string"))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, hashes, counts in sums_by_shard(batches):
            arrays.write(f"words-{shard}", hashes)
            if counts.max() >= 1 << 32:
                raise OverflowError("a word has 2**32 tokens or more")
            arrays.write(f"counts-{shard}", counts.astype(np.uint32))
            top = counts[hashes == END]
            often = np.argsort(-counts, kind="stable")[:HOT]
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "n": [len(hashes)], "tokens": [int(counts.sum())], "texts": [int(top.sum())],
                 "often": [often.tolist()], "often_n": [counts[often].tolist()]}
            )

    counted = texts.mapInArrow(counting(_word_keys, lambda h: hash_shard(h, shards)), SLICE)
    written = dealt(counted, shards).mapInArrow(
        write_words, "shard long, n long, tokens long, texts long, often array<long>, often_n array<long>"
    )
    found = {r["shard"]: r for r in written.collect()}
    tokens = sum(r["tokens"] for r in found.values())
    sizes = [found[k]["n"] if k in found else 0 for k in range(shards)]
    bases = tuple(np.concatenate([[0], np.cumsum(sizes)]).tolist())
    if bases[-1] + 1 >= 1 << 32:
        raise OverflowError("pairs of word numbers need fewer than 2**32 words")
    hot = {bases[k] + i for k, r in found.items() for i, c in zip(r["often"], r["often_n"], strict=True) if c * HOT >= tokens}
    hot.add(bases[-1])
    model = Model(folder, shards, bases, tokens, sum(r["texts"] for r in found.values()), tuple(sorted(hot)))
    return _with_pairs(texts, model) if tokens else model


def _with_pairs(texts: DataFrame, model: Model) -> Model:
    arrays, radix = SharedArrays(model.folder), np.uint64(model.words + 1)

    def pair_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, before, tokens = _sequences(data, offsets, _reader(model))
        return before.astype(np.uint64) * radix + tokens.astype(np.uint64)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(model.hot)
        for shard, keys, counts in sums_by_shard(batches):
            large = np.flatnonzero(counts >= 255)
            arrays.write(f"pairs-{shard}", keys)
            arrays.write(f"pair-counts-{shard}", np.minimum(counts, 255).astype(np.uint8))
            arrays.write(f"pair-large-{shard}", np.concatenate([large, counts[large]]))
            first, second = (keys // radix).astype(np.int64), keys % radix
            starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            own = first[starts]
            kinds = [np.add.reduceat((counts == c) if c < 3 else (counts >= 3), starts, dtype=np.int64) for c in (1, 2, 3)]
            is_hot = np.isin(own, hot)
            arrays.write(f"contexts-{shard}", np.concatenate([x[~is_hot].astype(np.uint32) for x in (own, *kinds)]))
            told = np.concatenate([[np.count_nonzero(counts == c) for c in (1, 2, 3, 4)], [len(keys)], own[is_hot], *(x[is_hot] for x in kinds)])
            yield pa.RecordBatch.from_pylist([{"shard": -1, "low": None, "high": None, "counts": told.astype(np.int64).tobytes()}], slice_schema())
            after, before = np.unique(second, return_counts=True)
            cuts = np.searchsorted(after, np.array(model.bases, dtype=np.uint64))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    yield pa.RecordBatch.from_pylist([packed(k, after[a:b], before[a:b])], slice_schema())

    def write_predecessors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[bytes] = []

        def slices() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told.extend(r["counts"] for r in batch.to_pylist() if r["shard"] < 0)
                yield batch.filter(pc.greater_equal(batch.column("shard"), 0))

        for shard, numbers, counts in sums_by_shard(slices()):
            base, end = model.bases[shard : shard + 2]
            before = np.zeros(end - base, dtype=np.uint32)
            before[numbers.astype(np.int64) - base] = counts
            arrays.write(f"before-{shard}", before)
            kinds = [np.count_nonzero(counts == c) for c in (1, 2, 3, 4)] + [len(counts)]
            yield pa.RecordBatch.from_pydict({"kind": [1], "told": pa.array([np.array(kinds, np.int64).tobytes()], pa.binary())})
        if told:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * len(told)), "told": pa.array(told, pa.binary())})

    counted = texts.mapInArrow(counting(pair_keys, lambda keys: _reader(model).pair_shard(keys)), SLICE)
    pairs = dealt(counted, model.shards).mapInArrow(write_pairs, SLICE)
    told = dealt(pairs, model.shards).mapInArrow(write_predecessors, "kind long, told binary").collect()
    for k in range(model.shards):  # shards to which no pair was dealt
        _fill_missing(arrays, k)
    kinds: dict[int, np.ndarray] = {0: np.zeros(5, np.int64), 1: np.zeros(5, np.int64)}
    contexts = dict.fromkeys(model.hot, np.zeros(3, np.int64))
    for r in told:
        values = np.frombuffer(r["told"], np.int64)
        kinds[r["kind"]] = kinds[r["kind"]] + values[:5]
        for number, *counts in values[5:].reshape(4, -1).T.tolist():
            contexts[number] = contexts[number] + np.array(counts)
    pair_discounts, word_discounts = (_discounts(kinds[k][:4]) for k in (0, 1))
    total, (n1, n2) = int(kinds[0][4]), kinds[1][:2]
    mass = word_discounts[1:] @ [n1, n2, kinds[1][4] - n1 - n2] / total
    return Model(
        model.folder, model.shards, model.bases, model.tokens, model.texts, model.hot,
        tuple(tuple(int(x) for x in contexts[h]) for h in model.hot),
        tuple(pair_discounts.tolist()), tuple(word_discounts.tolist()), total, float(mass),
    )


def _fill_missing(arrays: SharedArrays, shard: int) -> None:
    store, root = arrays._at()
    wanted = [f"{kind}-{shard}" for kind in ("pairs", "pair-counts", "pair-large", "contexts")]
    for name, info in zip(wanted, store.get_file_info([f"{root}/{x}" for x in wanted]), strict=True):
        if not info.is_file:
            arrays.write(name, np.zeros(0, np.uint8))


def log_probabilities(model: Model, before: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of the model's and of the add-0.1 probabilities of tokens, and the tokens' counts."""
    reader = _reader(model)
    distinct, each = np.unique(tokens, return_inverse=True)
    counts = reader.counts(distinct)
    base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))[each]
    lower = np.full(len(distinct), model.base_mass / (model.words + 1))
    if model.pairs:
        different = reader.predecessors(distinct)
        lower += (different - np.array(model.word_discounts)[np.minimum(different, 3)]) / model.pairs
    probability = lower[each]
    seen = np.flatnonzero(before >= 0) if model.pairs else np.zeros(0, np.int64)
    if len(seen):
        first, at = np.unique(before[seen], return_inverse=True)
        words = first < model.words
        total = np.full(len(first), float(model.texts))
        total[words] = reader.counts(first[words])
        discounts = np.array(model.pair_discounts)
        passed = reader.contexts(first) @ discounts[1:] / total
        probability[seen] *= passed[at]
        known = seen[tokens[seen] >= 0]
        keys = before[known].astype(np.uint64) * np.uint64(model.words + 1) + tokens[known].astype(np.uint64)
        keys, which = np.unique(keys, return_inverse=True)
        together = reader.pairs(keys)
        own = together - discounts[np.minimum(together, 3)]
        probability[known] += own[which] / total[np.searchsorted(first, before[known])]
    return np.log10(probability), base, counts[each]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    Scores are sums of log10 probabilities over the words and the end of the whole text; a word
    that training has not seen has the probability of one unknown word. A null or empty text is its end alone.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                row, before, tokens = _sequences(data, offsets[lo : hi + 1], reader)
                own, base, counts = log_probabilities(model, before, tokens)
                summed = lambda x, row=row, n=hi - lo: np.bincount(row, weights=x, minlength=n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(lo, hi - lo),
                        "n_tokens": pa.array(np.bincount(row, minlength=hi - lo)),
                        "n_known": pa.array(summed(counts > 0).astype(np.int64)),
                        "train_tokens": pa.array(np.full(hi - lo, model.tokens)),
                        "base_score": pa.array(summed(base)),
                        "score": pa.array(summed(own)),
                    }
                )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, schema)


def perplexity(score: Column, tokens: Column) -> Column:
    """Of a text, from its log10 probability and its tokens."""
    return F.pow(F.lit(10.0), -score / tokens)
