"""Exact top-k by inner product as a Voronoi kNN join.

Queries belong to the cell of their nearest pivot, and neighbouring cells form groups. A lower bound
of each query's k-th score comes from summaries: of the cells' sizes and radii, and of a sample's
scores. A row goes to a group only if the pivot and radius of one of its cells allow a score as high
as the cell's lowest bound. Where the vectors have no clusters, little can be ruled out, and
each row meets each group: then it is an exact scan in blocks, of queries times rows.
Rows travel as blocks of small integers; a unit of work has a bounded number of queries and a
salted part of the rows, and streams its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
#: Pivots: about the root of the rows, at least MIN_PIVOTS and at most MAX_PIVOTS.
MIN_PIVOTS, MAX_PIVOTS = 16, 512
#: Rows, lowest hash of their id first, whose scores bound a query's k-th score from below.
SAMPLE = 2048
#: Queries in a unit of work, and about how many rows.
QUERIES, ROWS = 1024, 1 << 17
#: Rows scored at once.
BLOCK = 2048


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long, null for a vector that takes no part."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(whole, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    found = np.zeros((len(sizes), width), dtype=np.int64)
    found[np.arange(width) < sizes[:, None]] = values
    return found


def _small(x: np.ndarray) -> np.ndarray:
    """In the smallest integers that hold the values."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: through doubles where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it, so that no cluster of it is without one."""
    rows = sample.astype(np.float64)
    chosen, apart = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < most and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


@dataclass(frozen=True)
class Cells:
    """Pivots, and of each cell's rows the number and the radius."""

    pivots: np.ndarray
    sizes: np.ndarray | None = None
    radii: np.ndarray | None = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its distance to the pivot, rounded up."""
        rows, pivots = x.astype(np.float64), self.pivots.astype(np.float64)
        squares = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)
        cell = squares.argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
        apart = np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1))
        return cell, apart * (1 + 1e-9) + 1e-9

    def kth_bound(self, queries: np.ndarray, k: int) -> np.ndarray:
        """What the k-th score of a query cannot be below, by the cells' sizes and radii alone.

        One row more is counted, as the query itself may be among them.
        """
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        least = queries.astype(np.float64) @ self.pivots.T.astype(np.float64) - norms[:, None] * self.radii
        least -= 1e-9 * np.abs(least) + 1e-6
        order = np.argsort(-least, axis=1)
        reached = np.cumsum(self.sizes[order], axis=1) > k
        at = np.argmax(reached, axis=1)
        found = np.take_along_axis(least, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
        return np.where(reached.any(axis=1), found, -np.inf)


def _best(owner: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each owner: highest score, then smallest id."""
    order = np.lexsort((vec, -score, owner))
    owner, score, vec = owner[order], score[order], vec[order]
    first = np.searchsorted(owner, owner, side="left")
    kept = np.arange(len(owner)) - first < k
    return owner[kept], score[kept], vec[kept]


def _sample_bound(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    scores = _products(queries, sample).astype(np.float64)
    scores[ids[:, None] == sample_ids] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(queries), -np.inf)
    return np.partition(scores, -k, axis=1)[:, -k]


UNIT = "part int, chunk int, salt int, kind int, type string, ids binary, vectors binary, bounds binary"


def _unit(group: int, chunk: int, salt: int, kind: int, ids: np.ndarray, x: np.ndarray, bounds=None) -> dict:
    small = _small(x)
    return {
        "part": group, "chunk": chunk, "salt": salt, "kind": kind, "type": small.dtype.str, "ids": ids.astype(np.int64).tobytes(),
        "vectors": small.tobytes(), "bounds": None if bounds is None else bounds.tobytes(),
    }


_UNIT_SCHEMA = pa.schema(
    [(n, pa.int32()) for n in ("part", "chunk", "salt", "kind")]
    + [("type", pa.string())]
    + [(n, pa.binary()) for n in ("ids", "vectors", "bounds")]
)


def top_k(
    rows: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` highest scores, all if fewer.

    Ties go to the smaller ``vec_id``. Candidates are all rows with another id than the query's.
    Rows without an id or with a vector that is null or holds a null or non-finite component take
    no part; missing components of shorter vectors count as zero. Repeated candidates are all
    ranked; of repeated queries one is answered, the smallest vector where they differ.
    """
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(embedding), scale).alias("v"), is_query.alias("is_query"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    queries = base.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = base.agg(F.max(F.size("v")), F.count("*"), F.count_if(F.coalesce("is_query", F.lit(False)))).collect()[0]
    width, n, n_queries = counts[0] or 0, counts[1], counts[2]
    schema = "query_id long, vec_id long, score long"
    if not n_queries:
        return _ranked(base.sparkSession.createDataFrame([], schema), k)
    taken = base.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids, sample = taken.column(0).to_numpy(), _matrix(taken.column(1).combine_chunks(), width)
    cells = _summary(base, Cells(spread_out(sample, min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(n))))), width)
    groups = _query_groups(queries, cells, sample, sample_ids, width, k)
    salts = max(1, -(-n // ROWS))

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            cell, _ = cells.nearest(x)
            bound = np.maximum(cells.kth_bound(x, k), _sample_bound(x, ids, sample, sample_ids, k))
            group = groups.of_cell[cell]
            chunk = _spread(ids) % groups.chunks[group]
            for g, h in {*zip(group.tolist(), chunk.tolist(), strict=True)}:
                own = (group == g) & (chunk == h)
                found = [_unit(g, h, s, 0, ids[own], x[own], bound[own]) for s in range(salts)]
                yield pa.RecordBatch.from_pylist(found, _UNIT_SCHEMA)

    def send_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            needed = groups.needed(x, cells)
            salt = _spread(ids) % salts
            for s in np.unique(salt).tolist():
                for g, chunks in enumerate(groups.chunks.tolist()):
                    own = np.flatnonzero(needed[:, g] & (salt == s))
                    for lo in range(0, len(own), BLOCK):
                        part = own[lo : lo + BLOCK]
                        for h in range(chunks):
                            yield pa.RecordBatch.from_pylist([_unit(g, h, s, 1, ids[part], x[part])], _UNIT_SCHEMA)

    sent = queries.mapInArrow(send_queries, UNIT).unionByName(base.select("vec_id", "v").mapInArrow(send_rows, UNIT))
    keys = ["part", "chunk", "salt"]
    spark_parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = sent.repartition(max(spark_parts, salts), *keys).sortWithinPartitions(*keys, "kind")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, solver = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["part"], row["chunk"], row["salt"]
                if key != unit:
                    if solver is not None:
                        yield solver.result()
                    unit, solver = key, _Solver(k)
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"], np.dtype(row["type"])).reshape(len(ids), width)
                if row["kind"]:
                    solver.add_rows(ids, x)
                else:
                    solver.add_queries(ids, x, np.frombuffer(row["bounds"]))
        if solver is not None:
            yield solver.result()

    return _ranked(units.mapInArrow(solve, schema), k)


class _Solver:
    """The best rows of a unit's queries so far."""

    def __init__(self, k: int):
        self._k, self._parts = k, []
        self._ids = None
        self._found = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add_queries(self, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> None:
        self._parts.append((ids, x.astype(np.int64), bounds))

    def add_rows(self, ids: np.ndarray, x: np.ndarray) -> None:
        if self._ids is None:
            if not self._parts:
                return
            self._ids, self._x, self._bounds = (np.concatenate(p) for p in zip(*self._parts, strict=True))
            self._bounds = self._bounds.copy()
        scores = _products(self._x, x)
        owner, column = np.nonzero((scores >= self._bounds[:, None]) & (self._ids[:, None] != ids))
        mine = (owner, scores[owner, column], ids[column])
        self._found = _best(*(np.concatenate(p) for p in zip(self._found, mine, strict=True)), self._k)
        owner, score, _ = self._found
        last = np.flatnonzero(np.bincount(owner, minlength=len(self._ids)) == self._k)
        if len(last):
            self._bounds[last] = score[np.searchsorted(owner, last, side="right") - 1]

    def result(self) -> pa.RecordBatch:
        owner, score, vec = self._found
        ids = self._ids[owner] if self._ids is not None else owner
        return pa.RecordBatch.from_pydict({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(vec), "score": pa.array(score)})


def _spread(ids: np.ndarray) -> np.ndarray:
    """Non-negative numbers that look random."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _summary(base: DataFrame, cells: Cells, width: int) -> Cells:
    """The cells with their sizes and radii; a row per cell comes to the driver."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
        for batch in batches:
            cell, apart = cells.nearest(_matrix(batch.column(0), width))
            np.add.at(n, cell, 1)
            np.maximum.at(radius, cell, apart)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(n))), "n": pa.array(n), "radius": pa.array(radius)})

    found = base.select("v").mapInArrow(assign, "cell long, n long, radius double")
    found = found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    sizes, radii = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
    for r in found:
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return Cells(cells.pivots, sizes, radii)


@dataclass(frozen=True)
class Groups:
    """Neighbouring cells with QUERIES queries or more together: ``of_cell`` numbers them, ``chunks`` cut the large ones.

    ``used`` are the cells with queries, group by group from ``starts`` on, with their ``radii`` and lowest ``bounds``.
    """

    used: np.ndarray
    starts: np.ndarray
    chunks: np.ndarray
    of_cell: np.ndarray
    radii: np.ndarray
    bounds: np.ndarray

    def needed(self, x: np.ndarray, cells: Cells) -> np.ndarray:
        """Which groups each row may matter to."""
        rows = x.astype(np.float64)
        norms = np.sqrt((rows**2).sum(axis=1))
        most = rows @ cells.pivots[self.used].T.astype(np.float64) + norms[:, None] * self.radii
        able = most + 1e-9 * np.abs(most) + 1e-6 >= self.bounds
        return np.logical_or.reduceat(able, self.starts, axis=1)


def grouped(cells: Cells, counts: np.ndarray, radii: np.ndarray, bounds: np.ndarray) -> Groups:
    """Groups of the cells that have queries; each next cell is the nearest one left."""
    used = np.flatnonzero(counts)
    pivots = cells.pivots.astype(np.float64)
    ordered, left = [], np.ones(len(used), dtype=bool)
    at = 0
    while left.any():
        left[at] = False
        ordered.append(at)
        apart = ((pivots[used] - pivots[used[at]]) ** 2).sum(axis=1)
        at = int(np.where(left, apart, np.inf).argmin())
    used = used[ordered]
    starts, held = [0], 0
    for k, n in enumerate(counts[used].tolist()):
        if held >= QUERIES or held and n >= QUERIES:
            starts.append(k)
            held = 0
        held += n
    sizes = np.add.reduceat(counts[used], starts)
    of_cell = np.zeros(len(counts), np.int64)
    of_cell[used] = np.repeat(np.arange(len(starts)), np.diff([*starts, len(used)]))
    return Groups(used, np.array(starts), -(-sizes // QUERIES), of_cell, radii[used], bounds[used])


def _query_groups(queries: DataFrame, cells: Cells, sample: np.ndarray, sample_ids: np.ndarray, width: int, k: int) -> Groups:
    """Of each cell the number and radius of its queries and the lowest bound of a k-th score; a row per cell comes to the driver."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            cell, apart = cells.nearest(x)
            bound = np.maximum(cells.kth_bound(x, k), _sample_bound(x, ids, sample, sample_ids, k))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "apart": pa.array(apart), "bound": pa.array(bound)})

    found = queries.mapInArrow(assign, "cell long, apart double, bound double")
    found = found.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.min("bound").alias("bound")).collect()
    counts, radii, bounds = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots)), np.full(len(cells.pivots), np.inf)
    for r in found:
        counts[r["cell"]], radii[r["cell"]], bounds[r["cell"]] = r["n"], r["radius"], r["bound"]
    return grouped(cells, counts, radii, bounds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
