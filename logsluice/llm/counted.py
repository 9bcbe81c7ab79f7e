"""Counts of 64-bit keys of texts: counted and sorted where they are read, summed by shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.words import row_groups, text_bytes

#: Distinct entries a counting task holds before it passes them on.
HELD = 1 << 18
SLICE = "shard int, low binary, high binary, counts binary"


def packed(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    """Sorted keys as differences in two halves, the upper of which is mostly zeros."""
    steps = np.diff(keys, prepend=np.uint64(0))
    low, high = (steps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (steps >> np.uint64(32)).astype(np.uint32)
    return {"shard": shard, "low": low.tobytes(), "high": high.tobytes(), "counts": counts.astype(np.uint64).astype(np.uint32).tobytes()}


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    low, high = (np.frombuffer(row[k], np.uint32).astype(np.uint64) for k in ("low", "high"))
    return np.cumsum((high << np.uint64(32)) | low, dtype=np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def counting(keys_of: Callable, shard_of: Callable) -> Callable:
    """A task that counts the keys of texts and sends each shard a sorted slice."""

    def passed_on(held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        shards = shard_of(keys)
        order = np.argsort(shards, kind="stable")
        keys, counts, shards = keys[order], counts[order], shards[order]
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield pa.RecordBatch.from_pylist([packed(int(shards[a]), keys[a:b], counts[a:b])], slice_schema())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_groups(offsets):
                keys, counts = np.unique(keys_of(data, offsets[lo : hi + 1]), return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > HELD:
                    held = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from passed_on(held)
                        held, size = [], 0
        if held:
            yield from passed_on(held)

    return count


def slice_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())])


def sums_by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The summed keys of each shard of a partition that is sorted by shard."""
    held: dict[int, list] = {}

    def finished() -> tuple[int, np.ndarray, np.ndarray]:
        (shard, slices), = held.items()
        held.clear()
        return shard, *added(*(np.concatenate(x) for x in zip(*slices, strict=True)))

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] not in held:
                yield finished()
            held.setdefault(row["shard"], []).append(unpacked(row))
    if held:
        yield finished()


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Each shard, numbered below ``n``, in a partition of its own."""
    return df.repartitionById(n, F.col("shard")).sortWithinPartitions("shard")


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
