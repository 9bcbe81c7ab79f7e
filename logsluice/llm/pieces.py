"""SentencePiece encoding and decoding as shortest paths through weighted transducers.

Three machines are compiled from a model file and composed with each stretch of text, only as far
as the text reaches:

- the normaliser rewrites characters: a space becomes the space mark, and a text starts with one;
- the lexicon rewrites a piece's characters to its id at the weight of its negative score, and a
  character that no piece has to its bytes' ids;
- the grammar allows two pieces side by side only if merging would leave them so: the model's
  pieces come from merges, and the sequence that merging gives is the one whose neighbours all
  leave each other alone.

States of the composition are a place in the text and the piece that ends there; the path of the
least sum of weights to the last place (the tropical semiring) gives the ids. Between two
characters that no piece has side by side, all paths meet: a text is a chain of stretches, about
its words, and the best path of each distinct stretch is remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.word_ids import RememberedIds
from logsluice.llm.words import AS_IS, Words, byte_set, mix, row_groups, split_words, text_bytes

SPACE = "▁"
_NONE = byte_set()
#: Neighbours a worker remembers.
PAIRS = 1 << 20
# Kinds of pieces in a model file.
_NORMAL, _USER, _BYTE = 1, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """Pieces by text with id and score, byte ids, and the bytes of every id."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    bytes_of: list[bytes]
    prefix: bool

    @staticmethod
    def read(path: str) -> Model:
        """From a model of merged pieces with byte fallback whose normaliser keeps the text."""
        with open(path, "rb") as file:
            raw = file.read()
        pieces, byte_ids, bytes_of, normaliser, kind = {}, [0] * 256, [], {}, 1
        for key, value in _fields(raw):
            if key == 1:
                piece = dict(_fields(value))
                text, number = piece[1].decode(), len(bytes_of)
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0])
                sort = piece.get(3, _NORMAL)
                shown = b""
                if sort == _BYTE:
                    shown = bytes([int(text[3:5], 16)])
                    byte_ids[shown[0]] = number
                elif sort in (_NORMAL, _USER):
                    pieces[text] = number, score
                    shown = text.replace(SPACE, " ").encode()
                bytes_of.append(shown)
            elif key == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif key == 3:
                normaliser = dict(_fields(value))
        if kind != 2 or normaliser.get(2) or normaliser.get(4, 1) or not all(byte_ids):
            raise ValueError("only merged pieces with byte fallback and an identity normaliser are supported")
        return Model(pieces, byte_ids, bytes_of, bool(normaliser.get(3, 1)))


class Grammar:
    """Which pieces may stand side by side."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self._pieces, self._known, self._pairs = pieces, {}, 0

    def merged(self, text: str) -> list[str]:
        """What merging makes of a text: again and again the pair of the best score, the leftmost of such."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        waiting: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(parts) and (found := self._pieces.get(parts[a] + parts[b])):
                heapq.heappush(waiting, (-found[1], a, b, parts[a] + parts[b]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while waiting:
            _, a, b, made = heapq.heappop(waiting)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != made:
                continue
            parts[a], parts[b] = made, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def after(self, piece: str) -> dict[str, bool]:
        """What is known of the pieces behind one; ``allows`` adds to it."""
        return self._known.setdefault(piece, {})

    def allows(self, a: str, b: str) -> bool:
        if self._pairs >= PAIRS:
            self._known.clear()
            self._pairs = 0
        self._pairs += 1
        found = self.after(a)[b] = self.merged(a + b) == [a, b]
        return found


class Transducer:
    """The composed machines."""

    def __init__(self, model: Model):
        self._model = model
        self._grammar = Grammar(model.pieces)
        self._begun = {p[:k] for p in model.pieces for k in range(1, len(p) + 1)}

    def _arcs(self, text: str, start: int) -> list[tuple[int, str | None, float]]:
        """Of the lexicon, from a place: end, piece (None: a character as bytes), weight."""
        pieces, begun, end = self._model.pieces, self._begun, start + 1
        found: list[tuple[int, str | None, float]] = [] if text[start] in pieces else [(end, None, 0.0)]
        while end <= len(text) and (part := text[start:end]) in begun:
            if (known := pieces.get(part)) is not None:
                found.append((end, part, -known[1]))
            end += 1
        return found

    def ids(self, stretch: str) -> list[int]:
        """Of a stretch of normalised text."""
        # At each place: by the piece that ends there, the least weight and the state before.
        states: list[dict] = [{} for _ in range(len(stretch) + 1)]
        states[0][None] = 0.0, None
        grammar = self._grammar
        for start in range(len(stretch)):
            here = states[start]
            if not here:
                continue
            arcs = self._arcs(stretch, start)
            for last, (weight, _) in here.items():
                follows = grammar.after(last) if last is not None else None
                for end, piece, more in arcs:
                    if follows is not None and piece is not None:
                        allowed = follows.get(piece)
                        if allowed is None:
                            allowed = grammar.allows(last, piece)
                        if not allowed:
                            continue
                    there = states[end]
                    if piece not in there or weight + more < there[piece][0]:
                        there[piece] = weight + more, (start, last)
        if not stretch:
            return []
        at, piece = len(stretch), min(states[-1], key=lambda p: states[-1][p][0])
        found: list[int] = []
        while at:
            start, last = states[at][piece][1]
            if piece is None:
                found += [self._model.byte_ids[b] for b in reversed(stretch[start].encode())]
            else:
                found.append(self._model.pieces[piece][0])
            at, piece = start, last
        return found[::-1]


def _joined_bytes(pieces: dict[str, tuple[int, float]]) -> np.ndarray:
    """Which byte may stand before which within a piece, a space mark as itself or as a space; within a
    character, any."""
    joined = np.zeros((256, 256), dtype=bool)
    joined[:, 0x80:0xC0] = True
    for piece in pieces:
        for shown in {piece, piece.replace(SPACE, " ")}:
            raw = np.frombuffer(shown.encode(), np.uint8)
            joined[raw[:-1], raw[1:]] = True
    return joined


class PieceIds(RememberedIds):
    """Ids of whole texts."""

    def __init__(self, path: str):
        super().__init__()
        self.model = Model.read(path)
        self._machine = Transducer(self.model)
        self._joined = _joined_bytes(self.model.pieces)

    def _starts(self, raw: np.ndarray) -> np.ndarray:
        """Where no piece can have both the byte and the one before it."""
        starts = np.zeros(len(raw), dtype=bool)
        starts[1:] = ~self._joined[raw[:-1], raw[1:]]
        return starts

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        words = split_words(data, offsets, _NONE, self._starts, AS_IS)
        self._opening = words.first[:-1][np.diff(words.first) > 0]
        if self.model.prefix:
            words.hashes[self._opening] = mix(words.hashes[self._opening] + np.uint64(1))
            self._opens = set(self._opening.tolist())
        else:
            self._opens = set()
        return words

    def _text(self, data: np.ndarray, words: Words, i: int) -> str:
        text = super()._text(data, words, i)
        return " " + text if i in self._opens else text

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(self._machine.ids(w.replace(" ", SPACE)), dtype=np.uint32) for w in words]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their bytes in a row, without the space a text starts with."""
        raw = b"".join(map(self.model.bytes_of.__getitem__, ids))
        if self.model.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    """One for each worker process."""
    return PieceIds(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row; a null text is empty and has no ids. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = piece_ids(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets, 1 << 21):
                ids, rows = machine(data, offsets[lo : hi + 1])
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "ids": lists})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = piece_ids(model)
        for batch in batches:
            texts = [machine.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Each row encoded and decoded again: ``n_tokens``, ``ids_crc32`` (little-endian uint32), ``n_bytes``
    (byte fallbacks), ``decoded_sha256`` (lowercase hex), ``same`` (the text came back).

    A null or empty text has no tokens and comes back as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = piece_ids(model)
        fallback = np.zeros(len(machine.model.bytes_of), dtype=bool)
        fallback[machine.model.byte_ids] = True
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets, 1 << 21):
                ids, rows = machine(data, offsets[lo : hi + 1])
                lists = [ids[a:b] for a, b in zip(rows, rows[1:], strict=False)]
                back = [machine.decode(x.tolist()).encode() for x in lists]
                given = [data[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(lo, hi - lo),
                        "n_tokens": pa.array(np.diff(rows)),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in lists], pa.int64()),
                        "n_bytes": pa.array([int(np.count_nonzero(fallback[x])) for x in lists], pa.int64()),
                        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                        "same": pa.array([a == b for a, b in zip(back, given, strict=True)], pa.bool_()),
                    }
                )

    schema = "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, decoded_sha256 string, same boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
