"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized where they are read; only one small row per piece is shuffled. Each
packer is a bounded-space online best-fit: it sees its pieces in the order of a hash, keeps a
fixed number of sequences open, and finds the fullest one that a piece fits into in a bitset
keyed by free space. When a piece fits nowhere and all places are taken, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsluice.llm.scale import parts
from logsluice.llm.word_ids import word_ids
from logsluice.llm.words import row_groups, text_bytes

CAPACITY = 4096
OPEN = 1024
END_ID = 1
#: Bytes of the input whose pieces go to one packer.
PACKER_BYTES = 1 << 29

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Each document's ids and ``end_id``, cut after every ``capacity`` ids.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked
    for, ``ids`` (little-endian uint32). A null or empty text is one piece of one id. Rows that
    repeat a document are documents of their own; a null ``doc_id`` stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                ids, rows = encode(data, offsets[lo : hi + 1], end_id)
                sizes = np.diff(rows)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = (rows[row] + start).tolist()
                raw = [ids[a : a + n] for a, n in zip(at, length.tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column(0).take(pa.array(row + lo)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array([x.tobytes() for x in raw], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECE_SCHEMA + ", ids binary" * keep_ids)


class OpenSequences:
    """A fixed number of open sequences: a bitset of the free spaces there are, and who has them."""

    def __init__(self, capacity: int, places: int):
        self._capacity, self._places = capacity, places
        self._bits, self._open, self._made = 0, 0, 0
        self._having: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        having = self._having[space]
        sequence = having.pop()
        if not having:
            self._bits ^= 1 << space
        self._open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it."""
        fitting = self._bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            if self._open == self._places:
                self._take((self._bits & -self._bits).bit_length() - 1)
            space, sequence = self._capacity, self._made
            self._made += 1
        left = space - length
        if left:
            self._having[left].append(sequence)
            self._bits |= 1 << left
            self._open += 1
        return sequence, self._capacity - space


def pack(pieces: DataFrame, packers: int, capacity: int = CAPACITY, places: int = OPEN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``length`` between 1 and ``capacity``.

    A packer holds its open sequences and one batch of rows, however many pieces it sees. Rows
    are dealt and ordered by their values, so a packer that runs again packs alike.
    """
    if not 0 < places:
        raise ValueError("places must be positive")
    keys = [c for c in pieces.columns if c != "ids"]
    dealt = pieces.withColumn("_order", F.xxhash64(*keys))
    dealt = dealt.repartition(max(1, packers), "_order").sortWithinPartitions("_order", *keys)
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*pieces.schema.fields, *added])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequences = OpenSequences(capacity, places)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([sequences.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            del named["_order"]
            yield pa.RecordBatch.from_pydict(
                named | {"sequence_id": pa.array(placed[:, 0] + base), "offset": pa.array(placed[:, 1])}
            )

    return dealt.mapInArrow(assign, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    places: int = OPEN,
    keep_ids: bool = False,
) -> DataFrame:
    """Documents tokenized, cut and packed; one packer for PACKER_BYTES of the input."""
    pieces = tokenized_pieces(docs, tokenizer, capacity, end_id, keep_ids)
    return pack(pieces, parts(docs, PACKER_BYTES), capacity, places)
