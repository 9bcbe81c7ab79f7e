"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, a block of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes for which temporary arrays are held at once; a longer word widens its block.
BLOCK = 1 << 18
#: Bytes of texts whose word arrays are held at once; a longer text is a group of its own.
GROUP = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that are set in the given ranges, ends included."""
    flags = np.zeros(256, dtype=bool)
    for first, last in ranges:
        flags[first : last + 1] = True
    return flags


#: ASCII white space: what separates words of `[^\x20\x09-\x0D]+`.
WHITE_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: What separates words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
NOT_ALPHANUMERIC = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def byte_values(seed: int) -> np.ndarray:
    """A random-looking uint64 for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 2 + 1))


class Powers:
    """Powers of an odd multiplier modulo 2**64 and their inverses, as many as asked for."""

    def __init__(self, multiplier: int = _MULTIPLIER):
        self._steps = multiplier, pow(multiplier, -1, 1 << 64)
        self._held = self._made(1 << 12)

    def _made(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        made = []
        for step in self._steps:
            powers = np.full(n, step, dtype=np.uint64)
            powers[0] = 1
            made.append(np.multiply.accumulate(powers))
        return made[0], made[1]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self._held[0]):
            self._held = self._made(max(n, 2 * len(self._held[0])))
        return self._held[0][:n], self._held[1][:n]


POWERS = Powers()
_C_LIBRARY = ctypes.CDLL(None)
_VALUES = byte_values(1)


@dataclass
class Words:
    """Words in order: byte positions in the buffer, hashes, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def row_groups(offsets: np.ndarray, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a batch that hold ``size`` bytes at most, or one row; memory is given back behind the last."""
    yield from byte_groups(offsets, size)
    release_memory()


def byte_groups(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def release_memory() -> None:
    """Give freed memory back after a batch: workers live on between tasks, and it would stay theirs."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_C_LIBRARY, "malloc_trim", None)) is not None:
        trim(0)


def split_words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE_SPACE, breaks=None, fold: np.ndarray = LOWER
) -> Words:
    """Maximal runs of bytes that are no separators once they are folded (A-Z to a-z); none crosses a row.

    ``breaks`` may name further places where a word begins: a function of the folded bytes of a
    block that returns flags. A block ends at a separator, or else at a break of two bytes.
    """
    starts, ends, hashes = [], [], []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + BLOCK, end)
        if hi < end:
            hi = _cut(data, offsets, separators, breaks, fold, lo, hi, end)
        block = _block_words(data, lo, hi, offsets, separators, breaks, fold)
        for held, made in zip((starts, ends, hashes), block, strict=True):
            held.append(made)
        lo = hi
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends)]
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(*joined, hashed, np.searchsorted(joined[0], offsets))


def _cut(data, offsets, separators, breaks, fold, lo, hi, end) -> int:
    """A place in (lo, end] where a block may end without cutting a word: the last up to hi, else the next."""

    def places(a: int, b: int) -> np.ndarray:
        folded = fold[data[a:b]]
        free = separators[folded]
        if breaks is not None and not separators.any():
            free = breaks(folded)
        return np.flatnonzero(free)

    row = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
    for size in (1 << 12, hi - lo):
        a = max(lo + 1, hi - size)
        found = places(a, hi)
        if len(found):
            return max(row, a + int(found[-1]))
    if row > lo:
        return row
    row = int(offsets[np.searchsorted(offsets, hi, side="left")])
    while hi < row:
        found = places(hi - 1, min(hi + BLOCK, row))
        if len(found):
            return hi - 1 + int(found[0])
        hi += BLOCK
    return min(row, end)


def _block_words(data, lo, hi, offsets, separators, breaks, fold):
    lower = fold[data[lo:hi]]
    inside = ~separators[lower]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
    begins[rows] = inside[rows]
    if breaks is not None:
        begins |= inside & breaks(lower)
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(stops) + 1
    powers, inverse = POWERS.upto(hi - lo + 1)
    sums = np.zeros(hi - lo + 1, dtype=np.uint64)
    np.cumsum(_VALUES[lower] * powers[:-1], out=sums[1:])
    return starts + lo, ends + lo, mix((sums[ends] - sums[starts]) * inverse[starts])


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within each row of the column, and the place of the first."""
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places = np.arange(total - n + 1)
    last_of_row = np.repeat(words.first[1:], np.diff(words.first))
    places = places[places + n <= last_of_row[: total - n + 1]]
    hashed = np.zeros(len(places), np.uint64)
    for k in range(n):
        hashed = mix(hashed * np.uint64(_MULTIPLIER) + words.hashes[places + k])
    return hashed, places
