"""Suffix arrays by induced sorting and permuted common prefixes, as whole-array steps."""

from __future__ import annotations

import numpy as np

from logsluice.llm.words import POWERS, mix

#: Alphabets up to this size are sorted by buckets; larger ones of names by pairs of ranks.
BUCKETS = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of an array of small non-negative integers, in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    kinds = _small_types(text)
    marks = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1
    if not len(marks):
        return _induced(text, kinds, marks)
    rough = _induced(text, kinds, marks)
    is_mark = np.zeros(n, dtype=bool)
    is_mark[marks] = True
    ordered = rough[is_mark[rough]]
    names = _names(text, marks, ordered)
    if names.max() + 1 < len(marks):
        order = suffix_array(names.astype(np.int16)) if names.max() < BUCKETS else _by_rank_pairs(names)
        ordered = marks[order]
    return _induced(text, kinds, ordered)


def _small_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last is not."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] > 0


def _induced(text: np.ndarray, small: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in theirs.

    A bucket holds first the larger, then the smaller suffixes of a symbol. Going up, larger
    suffixes are put behind what their bucket has; going down, smaller ones before it.
    """
    n, symbols = len(text), int(text.max()) + 1
    sizes = np.bincount(text, minlength=symbols)
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    order = np.full(n, -1, dtype=np.int64)
    marks_of = marks[np.argsort(text[marks], kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(text[marks], minlength=symbols))])
    head, tail = begin.copy(), end.copy()

    def forward(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if len(before) == 1:
            c = text[before[0]]
            order[head[c]] = before[0]
            head[c] += 1
        elif len(before):
            c = text[before]
            sort = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=symbols)
            first = np.cumsum(counts) - counts
            c = c[sort]
            order[head[c] + np.arange(len(c)) - first[c]] = before[sort]
            head[:] += counts

    def backward(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before) == 1:
            c = text[before[0]]
            tail[c] -= 1
            order[tail[c]] = before[0]
        elif len(before):
            c = text[before]
            sort = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=symbols)
            first = np.cumsum(counts) - counts
            c = c[sort]
            order[tail[c] - 1 - (np.arange(len(c)) - first[c])] = before[sort]
            tail[:] -= counts

    forward(np.array([n]))
    for c in np.flatnonzero(sizes).tolist():
        at = begin[c]
        while at < head[c]:
            at, batch = head[c], order[at : head[c]]
            forward(batch)
        forward(marks_of[cuts[c] : cuts[c + 1]])
    for c in np.flatnonzero(sizes)[::-1].tolist():
        at = end[c]
        while at > tail[c]:
            at, batch = tail[c], order[tail[c] : at]
            backward(batch[::-1])
        backward(order[begin[c] : head[c]][::-1])
    return order


def _sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = POWERS.upto(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers[:-1], out=sums[1:])
    return sums, inverse


def _names(text: np.ndarray, marks: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks, in the order of the text, of the stretches from one mark to the next, both included."""
    n = len(text)
    last = np.append(marks[1:] + 1, n)
    sums, inverse = _sums(text)
    hashed = mix((sums[last] - sums[marks]) * inverse[marks])
    size = last - marks
    size[-1] += 1  # the end is a symbol of its own
    place = np.searchsorted(marks, ordered)
    differs = (hashed[place][1:] != hashed[place][:-1]) | (size[place][1:] != size[place][:-1])
    names = np.empty(len(marks), dtype=np.int64)
    names[place] = np.concatenate([[0], np.cumsum(differs)])
    return names


def _by_rank_pairs(names: np.ndarray) -> np.ndarray:
    """Suffixes of names in order: names of 1, 2, 4 ... symbols until all differ."""
    n, span = len(names), 1
    rank = names
    while True:
        follower = np.zeros(n, dtype=np.int64)
        follower[: max(0, n - span)] = rank[span:] + 1
        keys = rank * (n + 1) + follower
        order = np.argsort(keys, kind="stable")
        ranks = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
        if ranks[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        span *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In the order of the text: what a suffix shares with the one before it in ``order``, and that one (-1: none).

    A prefix counts up to ``room`` symbols of both suffixes and up to ``most``. Where a suffix and the one
    before it in order stand behind equal symbols, they share one symbol less than the suffixes that
    start there do, so prefixes are only looked up where those symbols differ.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    own = (places == 0) | (before <= 0)
    own[1:] |= text[:-1] != text[before[1:] - 1]
    at = np.flatnonzero(own & (before >= 0))
    found = np.zeros(n, dtype=np.int64)
    found[at] = _shared(text, at, before[at])
    last = np.maximum.accumulate(np.where(own, places, 0))
    shared = np.maximum(found[last] - (places - last), 0)
    return np.where(before < 0, 0, np.minimum(np.minimum(shared, most), np.minimum(room, room[before]))), before


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, by hashes of four times as many each time, then halves."""
    sums, inverse = _sums(text)
    limit = len(text) - np.maximum(a, b)
    low, high = np.zeros(len(a), np.int64), limit + 1
    rest, reach = np.arange(len(a)), np.minimum(8, limit)

    def equal(k: np.ndarray, size: np.ndarray) -> np.ndarray:
        x, y = a[k], b[k]
        return (sums[x + size] - sums[x]) * inverse[x] == (sums[y + size] - sums[y]) * inverse[y]

    while len(rest):
        same = equal(rest, reach)
        high[rest[~same]] = reach[~same]
        low[rest[same]] = reach[same]
        rest, reach = rest[same], reach[same]
        further = reach < limit[rest]
        rest, reach = rest[further], np.minimum(4 * reach[further], limit[rest[further]])
    rest = np.flatnonzero(high - low > 1)
    while len(rest):
        middle = (low[rest] + high[rest]) // 2
        same = equal(rest, middle)
        low[rest[same]] = middle[same]
        high[rest[~same]] = middle[~same]
        rest = rest[high[rest] - low[rest] > 1]
    return low
