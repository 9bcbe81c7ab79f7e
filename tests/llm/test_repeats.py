"""Suffix arrays against sorted suffixes, and removal against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logsluice.llm import repeats, suffixes

RNG = random.Random(21)


def _texts():
    for _ in range(60):
        yield [RNG.randint(0, RNG.choice([1, 2, 3, 40])) for _ in range(RNG.randint(1, 300))]
    yield from ([0] * 200, list(range(50)), list(range(50, 0, -1)), [0, 1] * 90, [1, 0] * 90, [2, 1, 2, 1, 0] * 40, [0], [1, 1])
    base = [RNG.randint(0, 30) for _ in range(700)]
    yield base * 4 + [3] + base


@pytest.mark.parametrize("buckets", [1024, 3])
def test_suffix_array_and_common_prefixes(monkeypatch, buckets):
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    for text in _texts():
        array = np.array(text, np.int16)
        order = suffixes.suffix_array(array)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        room = np.arange(len(text), 0, -1)
        shared, before = suffixes.common_prefixes(array, order, room, 77)
        for k, i in enumerate(order.tolist()):
            want = 0
            if k:
                j = int(order[k - 1])
                assert before[i] == j
                while want < 77 and max(i, j) + want < len(text) and text[i + want] == text[j + want]:
                    want += 1
            assert shared[i] == want


def _brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    windows = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    found = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if windows[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        found.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return found


def _prose(n):
    return " ".join("".join(RNG.choice("aeinorstäß") for _ in range(RNG.randint(2, 8))) for _ in range(n))


def _corpus(length):
    passage, base = _prose(length // 2), _prose(300)
    texts = [None, "", "short", _prose(100), base, base, base.replace(" ", "\n", 3), "x" * (3 * length), "ab" * length * 2, "y" * (length + 1)]
    for _ in range(25):
        cut = RNG.randrange(len(passage) // 2)
        texts.append(_prose(RNG.randint(0, 60)) + passage[cut:] + _prose(RNG.randint(0, 60)))
    for _ in range(20):
        copy = list(base)
        for _ in range(RNG.randint(1, 6)):
            copy[RNG.randrange(len(copy))] = RNG.choice("XYZ")
        texts.append("".join(copy))
    texts.append(passage + _prose(3) + passage)
    exact = _prose(length)[:length]
    texts += [exact, _prose(20) + exact, exact[:-1] + "Q", "Z" + exact[1:]]
    return texts


@pytest.mark.parametrize("length, many, sorted_bytes, shard", [(200, 2048, 1 << 20, 1 << 30), (200, 3, 1 << 20, 6000), (60, 2048, 1, 6000), (60, 1, 1, 6000)])
def test_equals_all_windows(spark, tmp_path, monkeypatch, length, many, sorted_bytes, shard):
    for name, value in {"MANY": many, "SORTED": sorted_bytes, "SHARD_BYTES": shard}.items():
        monkeypatch.setattr(repeats, name, value)
    texts = _corpus(length)
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, repeats.find_repeats(docs, length)).collect()}
    for i, want in enumerate(_brute(texts, length)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept"]) == want, (i, texts[i] and texts[i][:50])


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_BLOCK", 1 << 10)
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 11) - 1))
    data = (_prose(2000) + "shift" + _prose(100)).encode()
    data += data[3000:7000] + _prose(50).encode()
    for offsets in ([0, len(data)], [0, 500, 5000, 5100, len(data)]):
        cuts, covered = np.array(offsets), []
        s = repeats.segments(np.frombuffer(data, np.uint8), cuts, 200)
        for row, start, n in zip(s.row, s.start, s.windows, strict=True):
            assert cuts[row] <= start and start + n + 199 <= cuts[row + 1]
            covered += range(start, start + n)
        want = [i for a, b in zip(offsets, offsets[1:], strict=False) for i in range(a, b - 199)]
        assert sorted(covered) == want


def test_odd_rows(spark):
    long = _prose(60)
    rows = [(1, long, "de", 1), (1, long, "de", 1), (None, "ä" * 300, None, 2), (3, None, "x", None), (4, "", "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_removed long")
    got = sorted((tuple(r) for r in repeats.dedup(docs).collect()), key=repr)
    assert got == sorted([(1, "", "de", 1), (1, "", "de", 1), (None, "", None, 2), (3, None, "x", None), (4, "", "y", 4)], key=repr)
    assert repeats.dedup(docs).columns == docs.columns
    assert repeats.dedup(docs.limit(0)).count() == 0
