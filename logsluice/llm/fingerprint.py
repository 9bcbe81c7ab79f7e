"""Document fingerprints of improbable features, in chained Bloom filters.

A feature is a window of 64 bytes. Its entropy class is the rarer the fewer windows of all
documents have it. A window that is the rarest (the leftmost of such) in many neighbourhoods of
64 windows is selected; selected windows go into Bloom filters in the order of the text, a new
filter after a fixed number. Filters are compared by the bits they share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.neighbours import with_successors
from logsluice.llm.scale import parts
from logsluice.llm.words import POWERS, byte_groups, byte_values, mix, row_groups, text_bytes

WINDOW = 64
NEIGHBOURHOOD = 64
POPULAR = 16
CLASSES = 1000
#: Classes up to this one are never selected: windows of few different bytes.
DULL = 100
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES, HASH_BITS = 5, 11
#: Part of the bits above chance that two filters may share without being alike.
TOLERANCE = 0.3
RANGE_BYTES = 32 << 20

_BLOCK = 1 << 16
_SCALE = 1 << 16
_n = np.arange(1, WINDOW + 1)
_WEIGHTS = np.concatenate([[0], np.rint(_n * np.log2(_n) * _SCALE)]).astype(np.int64)
_STEPS = np.diff(_WEIGHTS)
_MOST = int(_WEIGHTS[WINDOW])
_VALUES = byte_values(2)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class, 0 to CLASSES, of each window of WINDOW bytes; integers throughout."""
    total = max(0, len(data) - WINDOW + 1)
    classes = np.empty(total, dtype=np.int16)
    for lo in range(0, total, _BLOCK):
        hi = min(lo + _BLOCK, total)
        x = data[lo : hi + WINDOW - 1]
        before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
        for lag in range(1, WINDOW):
            same = (x[lag:] == x[:-lag]).view(np.uint8)
            before[lag:] += same
            after[:-lag] += same
        sums = np.empty(hi - lo, dtype=np.int64)
        sums[0] = _WEIGHTS[np.bincount(x[:WINDOW])].sum()
        sums[1:] = _STEPS[before[WINDOW:]] - _STEPS[after[: hi - lo - 1]]
        np.cumsum(sums, out=sums)
        classes[lo:hi] = (_MOST - sums) * CLASSES // _MOST
    return classes


def _own_windows(offsets: np.ndarray, total: int) -> np.ndarray:
    """Which windows of the joined texts lie within one text."""
    crossing = np.zeros(total + 1, dtype=np.int64)
    cuts = offsets[1:-1] - offsets[0]
    np.add.at(crossing, np.clip(cuts - WINDOW + 1, 0, total), 1)
    np.add.at(crossing, np.clip(cuts, 0, total), -1)
    return np.cumsum(crossing[:-1]) == 0


def class_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts are of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES + 1, dtype=np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets):
                classes = entropy_classes(data[offsets[lo] : offsets[hi]])
                counts += np.bincount(classes[_own_windows(offsets[lo : hi + 1], len(classes))], minlength=CLASSES + 1)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"class": pa.array(found.astype(np.int32)), "n": pa.array(counts[found])})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "class int, n long")
    counts = np.zeros(CLASSES + 1, dtype=np.int64)
    for r in rows.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Ranks of the classes, the rarest first; dull classes are behind all others."""
    order = np.lexsort((np.arange(len(counts)), counts, np.arange(len(counts)) <= DULL))
    ranks = np.empty(len(counts), dtype=np.int64)
    ranks[order] = np.arange(len(counts))
    return ranks


def _popularity(classes: np.ndarray, own: np.ndarray, ranks: np.ndarray, begins: np.ndarray, windows: np.ndarray):
    """For each window, how many neighbourhoods it is the rarest of."""
    total = len(classes)
    keys = np.full(total + NEIGHBOURHOOD, 1 << 62, dtype=np.int64)
    keys[:total] = np.where(own, (ranks[classes] << 40) | np.arange(total), 1 << 62)
    span = 1
    while span < NEIGHBOURHOOD:
        keys[:-span] = np.minimum(keys[:-span], keys[span:])
        span *= 2
    places = np.maximum(windows - NEIGHBOURHOOD + 1, np.minimum(windows, 1))
    starts = np.repeat(begins - np.cumsum(places) + places, places) + np.arange(places.sum())
    return np.bincount(keys[starts] & ((1 << 40) - 1), minlength=total), places


def select_features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each selected feature, in order; a hash counts once in a row.

    A text without a window, or with dull ones only, is one feature as a whole; an empty text
    has none.
    """
    n, base = len(offsets) - 1, int(offsets[0])
    x = data[base : offsets[-1]]
    sizes = np.diff(offsets)
    powers, inverse = POWERS.upto(len(x) + 1)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[x] * powers[:-1], out=sums[1:])
    classes = entropy_classes(x)
    begins, windows = offsets[:-1] - base, np.maximum(sizes - WINDOW + 1, 0)
    popularity, places = _popularity(classes, _own_windows(offsets, len(classes)), ranks, begins[windows > 0], windows[windows > 0])
    needed = np.zeros(n, dtype=np.int64)
    needed[windows > 0] = np.minimum(POPULAR, places)
    chosen = np.flatnonzero(popularity > 0)
    chosen = chosen[classes[chosen] > DULL]
    row = np.searchsorted(offsets, chosen + base, side="right") - 1
    enough = popularity[chosen] >= needed[row]
    # A text in which no window is popular enough has its most popular one.
    lacking = np.setdiff1d(row, row[enough])
    for r in lacking.tolist():
        of_row = np.flatnonzero(row == r) if len(lacking) < 64 else np.arange(*np.searchsorted(row, [r, r + 1]))
        enough[of_row[np.argmax(popularity[chosen[of_row]])]] = True
    at, row = chosen[enough], row[enough]
    hashes = (sums[at + WINDOW] - sums[at]) * inverse[at]
    whole = np.setdiff1d(np.flatnonzero(sizes > 0), row)
    first, end = offsets[whole] - base, offsets[whole + 1] - base
    hashes = mix(np.concatenate([hashes, (sums[end] - sums[first]) * inverse[first] + sizes[whole].astype(np.uint64)]))
    row = np.concatenate([row, whole])
    order = np.argsort(row, kind="stable")
    row, hashes = row[order], hashes[order]
    again = np.lexsort((np.arange(len(row)), hashes, row))
    new = np.ones(len(row), dtype=bool)
    new[again[1:]] = (row[again][1:] != row[again][:-1]) | (hashes[again][1:] != hashes[again][:-1])
    return row[new], hashes[new]


def filters(row: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's chain of filters: arrays of FILTER_BITS / 64 uint64 per filter."""
    counts = np.bincount(row, minlength=n)
    chain = -(-counts // FILTER_FEATURES)
    first = np.cumsum(chain) - chain
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    of = first[row] + nth // FILTER_FEATURES
    bits = np.zeros(int(chain.sum()) * FILTER_BITS, dtype=bool)
    for k in range(HASHES):
        bits[of * FILTER_BITS + ((hashes >> np.uint64(k * HASH_BITS)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").view(np.uint64).reshape(-1, FILTER_BITS // 64)
    return np.split(packed, first[1:]) if n else []


def _toward(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of ``a`` of the best overlap with a filter of ``b``, by their bits."""
    size_a, size_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a))
    for k in range(len(a)):
        shared = np.bitwise_count(a[k] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(size_a[k], size_b)
        chance = size_a[k] * size_b / FILTER_BITS
        floor = chance + TOLERANCE * (most - chance)
        best[k] = np.max(np.where(shared == most, 1.0, np.clip((shared - floor) / (most - floor), 0, 1)))
    return float((best * size_a).sum() / size_a.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, alike in both directions; the shorter chain is looked up in the longer one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b):
        return (_toward(a, b) + _toward(b, a)) / 2
    return _toward(*sorted((a, b), key=len))


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.uint64).reshape(-1, FILTER_BITS // 64)


def _chains(column: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    chains: list[np.ndarray] = []
    for lo, hi in byte_groups(offsets, 1 << 20):
        chains += filters(*select_features(data, offsets[lo : hi + 1], ranks), hi - lo)
    return chains


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row; equal texts have equal ones, a null text is empty."""
    ranks = rarity_ranks(class_counts(docs)) if ranks is None else ranks

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(c) for c in _chains(batch.column(1), ranks)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array(found, pa.string())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(digest, "doc_id long, fingerprint string")


def edited(text: str, successor: str) -> str:
    """The last half of the code points replaced by the first as many of the successor."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    Texts move once, into ranges of ``doc_id``; rows without an id come first, rows that share
    an id go by their text, and each repeated row is a document. The edited text takes its
    second half from the next document, the last one from the first.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranks = rarity_ranks(class_counts(rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_groups(offsets):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                chains = _chains(part.column("text"), ranks)
                rows = list(zip(part.column("doc_id").to_pylist(), part.column("ahead").to_pylist(), texts, chains, strict=True))
                rows = ([held] if held else []) + rows
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
                changed = [edited(a[2], b[2]) for a, b in pairs]
                after = _chains(pa.array(changed, pa.large_string()), ranks)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
                        "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                        "fingerprint": pa.array([as_text(a[3]) for a, _ in pairs], pa.string()),
                        "edited_fingerprint": pa.array([as_text(c) for c in after], pa.string()),
                        "near_edited": pa.array([likeness(a[3], c) for (a, _), c in zip(pairs, after, strict=True)], pa.float64()),
                        "near_next": pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    }
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(rows, parts(docs, RANGE_BYTES)).select("doc_id", "ahead", "text").mapInArrow(compare, schema)
