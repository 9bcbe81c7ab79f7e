"""Packing against the tokenizer itself and a search over all open sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsluice.llm import packing, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n", "It's 0 o'clock. The END, of 10 00 things", "a.b.c, d!, e... \t x y z", "Ünḯcóde Σς ΑΣ İ ǅ ﬁ",
    "é ́x", "<|endoftext|> a<|startoftext|>b", "0", "0 0", "'s 's, it'S", "日本語 テキスト。 0", "x" * 5000, "word " * 20_000,
    "%%% &&&, ***. a%. b,\nc.", "\x1c\x1d y\x0bz\x00", "tail.", "tail,\n", ".", ", ,", "😀😀 👍🏽.", "a" * (1 << 20), "b c" * 400_000,
]


def _ids(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def test_ids_equal_the_tokenizers(spark):
    rows = spark.createDataFrame([(i, x, "y", 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, piece string, ids int")
    got = {}
    for r in packing.tokenized_pieces(rows.repartition(3), PATH, keep_ids=True).collect():
        got.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, text in enumerate(TEXTS):
        want, pieces = _ids(text), [got[i][k] for k in range(len(got[i]))]
        assert b"".join(p["ids"] for p in pieces) == want.tobytes(), text[:40]
        assert [p["start"] for p in pieces] == list(range(0, len(want), 4096))
        assert all(p["length"] == len(p["ids"]) // 4 and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in pieces)


def test_random_texts_and_a_forgetful_worker(monkeypatch):
    monkeypatch.setattr(word_ids, "REMEMBERED", 50)
    rng = random.Random(5)
    encode = word_ids.WordIds(PATH)
    for _ in range(30):
        texts = ["".join(rng.choice("aB .,\n0'sé!%") for _ in range(rng.randint(0, 60))) for _ in range(8)]
        raw = [x.encode() for x in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        ids, rows = encode(data, offsets, 1)
        for k, text in enumerate(texts):
            assert ids[rows[k] : rows[k + 1]].tolist() == _ids(text).tolist()


def test_best_fit_takes_the_fullest_that_fits():
    rng = random.Random(3)
    for places in (1, 3, 40):
        sequences, free, closed = packing.OpenSequences(100, places), {}, set()
        for _ in range(3000):
            n = rng.randint(1, 100)
            fitting = [f for f in free.values() if f >= n]
            sequence, offset = sequences.place(n)
            assert sequence not in closed
            if fitting:
                assert free[sequence] == min(fitting) == 100 - offset
            else:
                assert offset == 0 and sequence not in free
                if len(free) == places:
                    fullest = min(free.values())
                    gone = [s for s, f in free.items() if f == fullest][-1]
                    del free[gone]
                    closed.add(gone)
            free.pop(sequence, None)
            free[sequence] = 100 - offset - n
            if not free[sequence]:
                del free[sequence]
                closed.add(sequence)
            assert len(free) <= places


def test_sequences_are_gapless_and_full(spark):
    rng = random.Random(1)
    rows = [(i % 4990 if i % 7 else None, " ".join(["word"] * int(rng.paretovariate(0.8) * 20))) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = packing.pack_documents(docs, PATH)
    got = out.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("rows")
    ).collect()
    for r in got:
        at = 0
        for x in r["rows"]:
            assert x["offset"] == at
            at += x["length"]
        assert at == r["n"] <= 4096
    total = sum(r["n"] for r in got)
    assert total == sum(len((x or "").split()) + 1 for _, x in rows)
    assert len(got) <= -(-total // 4096) * 1.01 + 3
    again = {tuple(r) for r in packing.pack_documents(docs, PATH).collect()}
    assert again == {tuple(r) for r in out.collect()}


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
