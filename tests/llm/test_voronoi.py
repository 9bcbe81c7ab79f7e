"""Top-k against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsluice.llm import voronoi

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def _brute(rows, k, every):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, v in {i: min(v for j, v in kept if j == i) for i, _ in kept if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(found)


def _ours(spark, rows, k, every):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in voronoi.top_k(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("seed, tight", [(1, False), (2, True)])
def test_equals_all_scores(spark, monkeypatch, seed, tight):
    if tight:
        for name, value in {"SAMPLE": 8, "MIN_PIVOTS": 5, "QUERIES": 7, "ROWS": 60, "BLOCK": 9}.items():
            monkeypatch.setattr(voronoi, name, value)
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]
    assert _ours(spark, rows, 4, 5) == _brute(rows, 4, 5)


def test_odd_rows(spark):
    rows = [(0, [0.1, -0.2]), (10, [1.0, 1.0]), (10, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (None, [1.0, 1.0]),
            (20, [float("nan"), 1.0]), (30, [float("inf"), 1.0]), (5, [None, 1.0]), (40, [0.7]), (50, []), (6, [-0.0, 100.0])]
    assert _ours(spark, rows, 20, 10) == _brute(rows, 20, 10)
    assert _ours(spark, [], 20, 10) == [] == _ours(spark, [(1, [1.0])], 20, 10) == _ours(spark, [(10, [1.0])], 20, 10)


def test_rows_that_cannot_matter_stay_where_they_are():
    rng = np.random.default_rng(0)
    near = rng.integers(90, 100, (50, 4))
    cells = voronoi.Cells(np.array([[95] * 4, [-95] * 4]), np.array([50, 50]), np.array([12.0, 12.0]))
    bound = cells.kth_bound(near, 20)
    assert (bound > 0).all() and (near @ np.array([-90] * 4) < bound).all()
    exact = np.sort(near @ near.T, axis=1)[:, -21]
    assert (bound <= exact).all()


def test_large_components_are_exact(spark):
    rows = [(i, [2.0**40 * (i - 5), 1.0]) for i in range(12)]
    rows = [(i, [min(max(x, -(2.0**23)), 2.0**23) for x in v]) for i, v in rows]
    assert _ours(spark, rows, 3, 2) == _brute(rows, 3, 2)


def _share_sent(x, every, k):
    """The share of (row, group) pairs that are sent, and the groups."""
    ids = np.arange(len(x))
    queries, query_ids = x[ids % every == 0], ids[ids % every == 0]
    pivots = voronoi.spread_out(x[:500], 40)
    cell, apart = voronoi.Cells(pivots).nearest(x)
    radii = np.zeros(len(pivots))
    np.maximum.at(radii, cell, apart)
    cells = voronoi.Cells(pivots, np.bincount(cell, minlength=len(pivots)), radii)
    cell, apart = cells.nearest(queries)
    bound = np.maximum(cells.kth_bound(queries, k), voronoi._sample_bound(queries, query_ids, x[:500], ids[:500], k))
    radii, bounds = np.zeros(len(pivots)), np.full(len(pivots), np.inf)
    np.maximum.at(radii, cell, apart)
    np.minimum.at(bounds, cell, bound)
    groups = voronoi.grouped(cells, np.bincount(cell, minlength=len(pivots)), radii, bounds)
    needed = groups.needed(x, cells)
    # What is left out is below the k-th score of every query of the group.
    exact = np.sort(np.where(query_ids[:, None] == ids, -(1 << 40), queries @ x.T), axis=1)[:, -k]
    for g in range(needed.shape[1]):
        own = groups.of_cell[cell] == g
        left_out = x[~needed[:, g]]
        assert own.any() and (queries[own] @ left_out.T < exact[own][:, None]).all()
    return needed.mean(), needed.shape[1]


def test_clustered_rows_go_to_few_groups_and_others_to_all(monkeypatch):
    monkeypatch.setattr(voronoi, "QUERIES", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(24, 32))
    centres *= 64 / np.linalg.norm(centres, axis=1)[:, None]
    clustered = np.floor(centres[rng.integers(0, 24, 4000)] + rng.normal(scale=1.5, size=(4000, 32))).astype(np.int64)
    share, groups = _share_sent(clustered, 10, 10)
    assert groups >= 6 and share < 0.3
    ball = np.floor(rng.normal(scale=8, size=(4000, 32))).astype(np.int64)
    share, groups = _share_sent(ball, 10, 10)
    assert share > 0.9 and groups >= 6


def test_pivots_leave_no_cluster_out():
    rng = np.random.default_rng(8)
    far = np.array([[0, 0], [1000, 0], [0, 1000]])
    sample = np.concatenate([far[0] + rng.integers(0, 9, (500, 2)), far[1:]])
    pivots = voronoi.spread_out(sample, 3)
    assert {tuple((p + 500) // 1000) for p in pivots} == {(0, 0), (1, 0), (0, 1)}
    assert len(voronoi.spread_out(np.ones((9, 2), np.int64), 5)) == 1
