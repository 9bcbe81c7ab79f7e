"""Ids equal the library's, and texts come back."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece

from logsluice.llm import pieces, words
from logsluice.llm.words import text_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "  a", "a  ", "Hello, world! It's 12.50€.", "a▁b ▁c", "ﬁ Ａ\x00é\n\n\tx  y   z      ", "😀👍🏽 日本語テキスト 门",
    "<s> </s> <0x41> <unk>", "a" * 300, "ab" * 200, " " * 70, "----====____####", "def f(x):\n    return x  # no\n" * 20, " \xa0　x", "word " * 5000,
    "Ungebräuchlich, daß. Über", "ciónarll, ñandú", "x" * 3000 + " y",
]


def _library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _ours(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    ids, rows = pieces.PieceIds(PATH)(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)]


@pytest.mark.parametrize("block", [1 << 18, 16])
def test_ids_equal_the_library(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    library, rng = _library(), random.Random(8)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = TEXTS + ["".join(rng.choice(known) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdeimnoprstu ,.-'0=_\n") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for text, ids in zip(texts, _ours(texts), strict=True):
        assert ids == library.encode(text or ""), text


def test_shortest_path_among_all_paths():
    """Of all ways to write a short text in pieces, the grammar leaves one."""
    model = pieces.Model.read(PATH)
    grammar, machine = pieces.Grammar(model.pieces), pieces.Transducer(model)

    def paths(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in model.pieces:
                for rest in paths(text[k:]):
                    yield [text[:k], *rest]

    for text in ("▁there", "▁inner", "▁▁▁x", "tionnn", "▁banana"):
        left = [p for p in paths(text) if all(grammar.merged(a + b) == [a, b] for a, b in zip(p, p[1:], strict=False))]
        assert [[model.pieces[x][0] for x in p] for p in left] == [machine.ids(text)]


def test_round_trip_in_spark(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int").repartition(3)
    library = _library()
    for r in pieces.round_trip(docs, PATH).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = library.encode(text)
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, np.uint32)))
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r["same"] == ("▁" not in text) and r["n_bytes"] == sum(library.is_byte(i) for i in ids)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0 == pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count()


def test_a_forgetful_worker(monkeypatch):
    from logsluice.llm import word_ids

    monkeypatch.setattr(word_ids, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    library, machine = _library(), pieces.PieceIds(PATH)
    for text in ["the quick brown fox", "jumps over the lazy dog " * 3, "and so on, and on"]:
        data, offsets = text_bytes(pa.array([text]))
        assert machine(data, offsets)[0].tolist() == library.encode(text)
