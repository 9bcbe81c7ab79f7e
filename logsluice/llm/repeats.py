"""Removal of byte strings that occur twice, by suffix arrays over the stretches that can repeat.

Every window of 200 bytes belongs to one anchor: the leftmost smallest hash of its 32-byte grams.
Equal windows have equal anchors at equal places, so windows need only be compared within an
anchor. Windows of a text that follow each other and have one anchor form a segment. All segments
are counted, whatever the input. A segment that occurs twice is repeated as a whole. Where an
anchor has several different segments, these are sorted together: a suffix array by induced
sorting for each shard of anchors, and permuted common prefixes that tell which windows also
start elsewhere. Anchors with very many segments, such as those at the edge of a passage that
whole parts of the corpus share, have their windows counted like segments instead, so that no
task gets all of them. Counts, and what sorting found, are sorted arrays in the shared folder;
texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from logsluice.llm.counted import SLICE, added, dealt, hash_shard, packed, slice_schema, sums_by_shard
from logsluice.llm.scale import parts, quoted, saved, shared_folder
from logsluice.llm.shared_arrays import SharedArrays
from logsluice.llm.suffixes import common_prefixes, suffix_array
from logsluice.llm.words import POWERS, byte_groups, byte_values, mix, row_groups, text_bytes

SHARD_BYTES = 8 << 20
GRAM = 32
#: Different segments of an anchor from which on its windows are counted.
MANY = 2048
#: Bytes of segments sorted at once; an anchor is never split.
SORTED = 1 << 20
#: Bytes that are cut at once: their arrays stay in a core's cache.
_BLOCK = 1 << 17
_PLACE = np.uint64(_BLOCK * 2 - 1)
_FIRST, _SECOND, _THIRD = byte_values(3), byte_values(4), byte_values(5)


@dataclass
class Segments:
    """Of joined texts: row, first window (a byte position), windows, and hashes."""

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    spread: np.ndarray  # the other half of the hash: the shard, so that keys of a shard differ in more bits than they have


class Sums:
    """Hashes of any stretch of a block of bytes."""

    def __init__(self, x: np.ndarray, values: np.ndarray):
        powers, self._inverse = POWERS.upto(len(x) + 1)
        self._sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(values[x] * powers[:-1], out=self._sums[1:])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return (self._sums[start + size] - self._sums[start]) * self._inverse[start]


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Segments:
    """All segments of some rows; a row is cut into blocks of windows counted from its own start."""
    found = []
    for row, lo, hi in _blocks(offsets, length):
        found.append(_block_segments(data, offsets, row, lo, hi, length))
    if not found:
        return Segments(*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(3)))
    return Segments(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """First row, first byte and end of blocks: several rows, or a part of one."""
    for a, b in byte_groups(offsets, _BLOCK):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= _BLOCK:
            yield a, lo, hi
        else:
            for at in range(lo, max(lo + 1, hi - length + 1), _BLOCK - length + 1):
                yield a, at, min(at + _BLOCK, hi)


def _block_segments(data, offsets, row, lo, hi, length) -> tuple:
    x = data[lo:hi]
    cuts = offsets[row : np.searchsorted(offsets, hi, side="left") + 1]
    starts = np.clip(cuts[:-1] - lo, 0, None)
    ends = np.minimum(cuts[1:], hi) - lo
    windows = np.maximum(ends - starts - length + 1, 0)
    total = int(windows.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return empty, empty, empty, *(np.zeros(0, np.uint64),) * 3
    at = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(total)
    of_row = np.repeat(np.arange(row, row + len(windows)), windows)
    grams = mix(Sums(x, _FIRST)(np.arange(len(x) - GRAM + 1), GRAM))
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_minimum(keyed, length - GRAM + 1)[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(new, total))
    first, anchors = at[new], grams[anchor[new]]
    held = memoryview(x)
    ends = (first + count + length - 1).tolist()
    digests = b"".join(xxh3_128_digest(held[a:b]) for a, b in zip(first.tolist(), ends, strict=True))
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return of_row[new], first + lo, count, anchors, halves[:, 0], halves[:, 1]


def _window_keys(data: np.ndarray, own: Segments, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of some segments: key, spread, segment, and number in it."""
    keys, spreads = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for start, n in zip(own.start.tolist(), own.windows.tolist(), strict=True):
        x, at = data[start : start + n + length - 1], np.arange(n)
        keys.append(mix(Sums(x, _SECOND)(at, length)))
        spreads.append(mix(Sums(x, _THIRD)(at, length)))
    segment = np.repeat(np.arange(len(own.start)), own.windows)
    number = np.arange(len(segment)) - np.repeat(np.cumsum(own.windows) - own.windows, own.windows)
    return np.concatenate(keys), np.concatenate(spreads), segment, number


def _shard(spread: np.ndarray, shards: int) -> np.ndarray:
    return hash_shard(spread, shards)


@dataclass(frozen=True)
class Found:
    """Where the arrays are, and which shards have some."""

    folder: str
    shards: int
    length: int


class Reader:
    """Sorted arrays of a job, mapped once in a worker; missing ones are empty."""

    def __init__(self, found: Found):
        self._arrays, self._open, self._shards = SharedArrays(found.folder), {}, found.shards
        self._have = self._arrays.names()

    def _array(self, name: str, dtype=np.uint64) -> np.ndarray:
        if name not in self._open:
            self._open[name] = self._arrays.read(name, dtype) if name in self._have else np.zeros(0, dtype)
        return self._open[name]

    def has(self, kind: str, keys: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Which keys are in the arrays of this kind."""
        found = np.zeros(len(keys), dtype=bool)
        shards = _shard(spread, self._shards)
        order = np.lexsort((keys, shards))
        cuts = [0, *(np.flatnonzero(np.diff(shards[order])) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and len(known := self._array(f"{kind}-{shards[order[a]]}")):
                own = order[a:b]
                place = np.searchsorted(known, keys[own])
                place[place == len(known)] = 0
                found[own] = known[place] == keys[own]
        return found

    def parts(self, key: int, shard: int) -> np.ndarray:
        """Windows of a segment that sorting found elsewhere: first and number of each run."""
        table = self._array(f"parts-{shard}").reshape(3, -1)
        a, b = np.searchsorted(table[0], np.array([key, key], np.uint64), side="left")[0], np.searchsorted(table[0], np.uint64(key), side="right")
        return table[1:, a:b].T.astype(np.int64)


@lru_cache(maxsize=2)
def _reader(found: Found, stage: int) -> Reader:
    """``stage`` tells apart readers that were opened before and after arrays were added."""
    return Reader(found)


def _slices(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> Iterator[dict]:
    order = np.lexsort((keys, shards))
    keys, counts, shards = keys[order], counts[order], shards[order]
    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield packed(int(shards[a]), keys[a:b], counts[a:b])


def _count_segments(texts: DataFrame, found: Found) -> int:
    """Write the keys of segments that occur twice, and the anchors of several segments; how many have very many."""
    arrays, shards, length = SharedArrays(found.folder), found.shards, found.length

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets, 8 << 20):
                s = segments(data, offsets[lo : hi + 1], length)
                order = np.lexsort((s.key, _shard(s.spread, shards)))
                key, anchor, shard = s.key[order], s.anchor[order], _shard(s.spread, shards)[order]
                if not len(key):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])]))
                times = np.diff(np.append(first, len(key)))
                key, anchor, shard = key[first], anchor[first], shard[first]
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(key)]
                rows = [packed(int(shard[a]), key[a:b], times[a:b]) | {"anchors": anchor[a:b].tobytes()} for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pylist(rows, slice_schema().append(pa.field("anchors", pa.binary())))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, times, anchors in _keyed_sums(batches):
            arrays.write(f"segments-{shard}", keys[times > 1])
            several, n = added(anchors, np.ones(len(anchors), np.int64))
            yield pa.RecordBatch.from_pylist(list(_slices(several, n, hash_shard(several, shards))), slice_schema())

    def write_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, anchors, n in sums_by_shard(batches):
            arrays.write(f"anchors-{shard}", anchors[(n > 1) & (n <= MANY)])
            arrays.write(f"wide-{shard}", anchors[n > MANY])
            yield pa.RecordBatch.from_pydict({"n": [int((n > MANY).sum())]})

    counted = texts.mapInArrow(count, SLICE + ", anchors binary")
    anchors = dealt(counted, shards).mapInArrow(write, SLICE)
    return dealt(anchors, shards).mapInArrow(write_anchors, "n long").agg(F.sum("n")).first()[0] or 0


def _keyed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Like sums_by_shard, with the anchor of each key."""
    held: dict[int, list] = {}

    def finished():
        (shard, rows), = held.items()
        held.clear()
        keys = np.concatenate([np.cumsum(_steps(r), dtype=np.uint64) for r in rows])
        times = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        anchors = np.concatenate([np.frombuffer(r["anchors"], np.uint64) for r in rows])
        order = np.argsort(keys, kind="stable")
        keys, anchors = keys[order], anchors[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return shard, keys[first], np.add.reduceat(times[order], first), anchors[first]

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] not in held:
                yield finished()
            held.setdefault(row["shard"], []).append(row)
    if held:
        yield finished()


def _steps(row: dict) -> np.ndarray:
    low, high = (np.frombuffer(row[k], np.uint32).astype(np.uint64) for k in ("low", "high"))
    return (high << np.uint64(32)) | low


def _sort_segments(texts: DataFrame, found: Found, wide: bool) -> None:
    """Write the repeated windows of the segments of anchors that have several.

    With ``wide`` there are anchors that have very many: the keys of their windows that occur twice are written.
    """
    arrays, shards, length = SharedArrays(found.folder), found.shards, found.length
    counted = [("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())]
    fields = [("shard", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64()), ("own_shard", pa.int32()), ("whole", pa.bool_()), ("bytes", pa.binary())]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sent = _reader(found, 1), set()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets):
                s = segments(data, offsets[lo : hi + 1], length)
                if wide:
                    slices = list(_window_slices(data, _chosen(s, reader.has("wide", s.anchor, s.anchor)), length, shards))
                    if slices:
                        yield pa.RecordBatch.from_pylist(slices, pa.schema([*fields, *counted]))
                mine = np.flatnonzero(reader.has("anchors", s.anchor, s.anchor))
                whole = reader.has("segments", s.key[mine], s.spread[mine])
                shard, own = hash_shard(s.anchor[mine], shards), _shard(s.spread[mine], shards)
                rows = []
                for k, i in enumerate(mine.tolist()):
                    if whole[k]:  # others need it once; it may come again from other tasks
                        if (name := (int(own[k]), int(s.key[i]))) in sent:
                            continue
                        if len(sent) >= 1 << 18:
                            sent.clear()
                        sent.add(name)
                    at = int(s.start[i])
                    rows.append((int(shard[k]), s.anchor[i].astype(np.int64), s.key[i].astype(np.int64), int(own[k]), bool(whole[k]), data[at : at + int(s.windows[i]) + length - 1].tobytes()))
                if rows:
                    made = [pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                    if wide:
                        made += [pa.nulls(len(rows), t) for _, t in counted]
                    yield pa.RecordBatch.from_arrays(made, [n for n, _ in [*fields, *counted]][: len(made)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, anchor, last = [], 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                name = row["anchor"], row["key"], row["own_shard"]
                if name == last:
                    continue
                last = name
                if row["anchor"] != anchor and size > SORTED:
                    yield from _repeated_windows(group, length)
                    group, size = [], 0
                anchor = row["anchor"]
                group.append(row)
                size += len(row["bytes"])
        if group:
            yield from _repeated_windows(group, length)

    def write_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, times in sums_by_shard(batches):
            arrays.write(f"windows-{shard}", keys[times > 1])
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            for k in sorted(set(batch.column("shard").to_pylist())):
                if k != shard:
                    if held:
                        _write_parts(arrays, shard, held)
                    held, shard = [], k
                held.append(batch.filter(pc.equal(batch.column("shard"), k)))
        if held:
            _write_parts(arrays, shard, held)
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    schema = "shard int, anchor long, key long, own_shard int, whole boolean, bytes binary"
    if wide:
        both = saved(texts.mapInArrow(send, schema + ", low binary, high binary, counts binary"), "segments")
        windows = both.where("bytes IS NULL").select("shard", "low", "high", "counts")
        dealt(windows, shards).mapInArrow(write_windows, "n long").agg(F.sum("n")).collect()
        sent = both.where("bytes IS NOT NULL").drop("low", "high", "counts")
    else:
        sent = texts.mapInArrow(send, schema)
    sent = sent.repartition(shards, "anchor").sortWithinPartitions("anchor", "key", "own_shard")
    solved = sent.mapInArrow(solve, "shard int, key long, first long, n long")
    dealt(solved, shards).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _write_parts(arrays: SharedArrays, shard: int, held: list[pa.RecordBatch]) -> None:
    table = pa.Table.from_batches(held)
    key, first, n = (table.column(c).to_numpy().astype(np.uint64) for c in ("key", "first", "n"))
    order = np.lexsort((first, key))
    arrays.write(f"parts-{shard}", np.concatenate([x[order] for x in (key, first, n)]))


def _repeated_windows(group: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    """Sort the segments of some anchors and tell which windows of the single ones start elsewhere, too."""
    sizes = np.array([len(r["bytes"]) for r in group])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    joined = np.frombuffer(b"\0".join(r["bytes"] for r in group) + b"\0", np.uint8)
    text = joined.astype(np.int16) + 1
    text[ends] = 0
    order = suffix_array(text)
    room = np.repeat(ends, sizes + 1) - np.arange(len(text))
    shared, before = common_prefixes(text, order, room, length)
    hit = np.flatnonzero(shared >= length)
    exact = np.ones(len(hit), dtype=bool)
    for k in range(0, length, 8):
        exact &= (joined[hit[:, None] + np.arange(k, min(k + 8, length))] == joined[before[hit][:, None] + np.arange(k, min(k + 8, length))]).all(axis=1)
    repeated = np.zeros(len(text), dtype=bool)
    repeated[hit[exact]] = True
    repeated[before[hit[exact]]] = True
    at = np.flatnonzero(repeated)
    if not len(at):
        return
    segment = np.searchsorted(ends, at)
    single = np.array([not r["whole"] for r in group])[segment]
    at, segment = at[single], segment[single]
    if not len(at):
        return
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])]))
    n = np.diff(np.append(new, len(at)))
    owner = segment[new].tolist()
    yield pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([group[i]["own_shard"] for i in owner], pa.int32()),
            "key": pa.array([group[i]["key"] for i in owner], pa.int64()),
            "first": pa.array(at[new] - starts[segment[new]], pa.int64()),
            "n": pa.array(n, pa.int64()),
        }
    )


def _window_slices(data: np.ndarray, own: Segments, length: int, shards: int) -> Iterator[dict]:
    """The windows of some segments, counted and packed by shard."""
    keys, spread, _, _ = _window_keys(data, own, length)
    if not len(keys):
        return
    shard = _shard(spread, shards)
    order = np.lexsort((keys, shard))
    keys, shard = keys[order], shard[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (shard[1:] != shard[:-1])]))
    yield from _slices(keys[first], np.diff(np.append(first, len(keys))), shard[first])


def _chosen(s: Segments, mine: np.ndarray) -> Segments:
    return Segments(*(x[mine] for x in (s.row, s.start, s.windows, s.anchor, s.key, s.spread)))


def find_repeats(docs: DataFrame, length: int = 200) -> Found:
    """Sort what may occur twice in all ``text``; what was found stays in the shared folder."""
    found = Found(shared_folder(docs.sparkSession, "repeats"), parts(docs, SHARD_BYTES), length)
    texts = docs.select(F.col("text").cast("string"))
    wide = _count_segments(texts, found)
    _sort_segments(texts, found, wide > 0)
    return found


def _removed(data: np.ndarray, offsets: np.ndarray, found: Found, reader: Reader) -> np.ndarray:
    """Which bytes of some rows, from the first one's start, are to go."""
    base, length = int(offsets[0]), found.length
    s = segments(data, offsets, length)
    whole = reader.has("segments", s.key, s.spread)
    first, windows = [s.start[whole]], [s.windows[whole]]
    rest = _chosen(s, ~whole)
    sorted_too = np.flatnonzero(reader.has("anchors", rest.anchor, rest.anchor))
    shards = _shard(rest.spread[sorted_too], found.shards)
    for i, shard in zip(sorted_too.tolist(), shards.tolist(), strict=True):
        runs = reader.parts(int(rest.key[i]), shard)
        if len(runs):
            first.append(rest.start[i] + runs[:, 0])
            windows.append(runs[:, 1])
    wide = _chosen(rest, reader.has("wide", rest.anchor, rest.anchor))
    keys, spread, segment, number = _window_keys(data, wide, length)
    again = reader.has("windows", keys, spread)
    first.append(wide.start[segment[again]] + number[again])
    windows.append(np.ones(int(again.sum()), np.int64))
    change = np.zeros(int(offsets[-1]) - base + 1, dtype=np.int64)
    at = np.concatenate(first) - base
    np.add.at(change, at, 1)
    np.add.at(change, at + np.concatenate(windows) + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, found: Found, kept_as: str | None = "binary") -> DataFrame:
    """``docs`` with ``kept`` (what stays), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    ``kept_as``: "binary", "string" without bytes that no longer form a character, or None for no ``kept``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in ``docs``,
    in the same text or another; matches do not cross texts, and overlaps count. Strings are
    judged on the input. A null text is empty. Each repeated row is a text of its own.
    """
    names = docs.columns
    at = names.index("text")
    extra = {"kept": kept_as} if kept_as else {}
    extra |= {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(found, 2)
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for lo, hi in row_groups(offsets):
                cuts = offsets[lo : hi + 1] - offsets[lo]
                gone = _removed(data, offsets[lo : hi + 1], found, reader)
                starts = gone & ~np.concatenate([[False], gone[:-1]])
                starts[cuts[:-1][cuts[:-1] < len(gone)]] = gone[cuts[:-1][cuts[:-1] < len(gone)]]
                upto = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts)]
                block = data[offsets[lo] : offsets[hi]]
                kept = [block[a:b][~gone[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                made = []
                if kept_as == "string":
                    made.append(pa.array([k.decode(errors="ignore") for k in kept], pa.string()))
                elif kept_as:
                    made.append(pa.array(kept, pa.binary()))
                made += [pa.array(np.diff(cuts)), *(pa.array(u[cuts[1:]] - u[cuts[:-1]]) for u in upto)]
                made.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *made], [*names, *extra])

    clean = docs.withColumn("text", F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields)
    return clean.mapInArrow(cut, ", ".join([fields, *(f"{n} {t}" for n, t in extra.items())]))


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with what stays of each text in its place; bytes that no longer form a character go, too.

    A text from which nothing is removed keeps its rows as they are, null included.
    """
    # Names of the caller's columns are set aside, so that none can meet a made one.
    safe = docs.select(*(quoted(c).alias("text" if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)))
    cut = remove_repeats(safe, find_repeats(docs, length), "string")
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return cut.select(*(F.col("text" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
