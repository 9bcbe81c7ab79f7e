"""Links and components against the comparison of every pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logsluice.llm import shingle_join
from logsluice.llm.components import components
from logsluice.llm.shingle_join import Settings


def _set(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[k:] for k in range(n)), strict=False))


def _brute(rows, s=Settings()):  # noqa: B008
    """By union and find over all pairs; ids must differ."""
    sets = {i: _set(t, s.words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= s.percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _ours(spark, rows, s=Settings()):  # noqa: B008
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.near_duplicates(docs, s).collect()}


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(40)]
    for size in (1, 2, 3, 9, 12, 30, 150, 150, 300):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(max(1, len(copy)))
                kind = rng.random()
                copy[at : at + 1] = [rng.choice(words)] if kind < 0.6 else [] if kind < 0.8 else [*copy[at : at + 1], rng.choice(words)]
            rows.append(" ".join(copy) if rng.random() < 0.9 else "\n".join(copy).upper())
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + " " + " ".join(passage) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", "  \n", "the the the the the", "the the the", "A b", "a\tB", "a"], start=5))


@pytest.mark.parametrize("seed, settings", [(1, Settings()), (2, Settings(percent=80)), (3, Settings(words=5, percent=80))])
def test_equals_all_pairs(spark, seed, settings):
    rows = _corpus(seed)
    assert _ours(spark, rows, settings) == _brute(rows, settings)


def test_chains_and_long_texts(spark):
    base = [f"t{i}" for i in range(60)]
    rows = []
    for k in range(25):
        rows.append((100 - k, " ".join(base[k : k + 36])))
    rows += [(200, "x " * 200_000), (201, "X " * 100), (202, " ".join(f"z{i}" for i in range(60_000))), (203, " ".join(f"z{i}" for i in range(200, 60_000)))]
    assert _ours(spark, rows) == _brute(rows)


def test_a_large_group_is_compared_with_its_centre(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            copy[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows.append((999, " ".join(base)))
    assert _ours(spark, rows) == _brute(rows)


def test_odd_ids_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x y z w"), (3, "x y z w"), (None, "a b c d"), (None, "only here twice"), (None, "only here twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingle_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (3, 1), (None, 1), (None, None), (None, None)], key=repr)
    assert shingle_join.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(i, t) for i, t in _corpus(4)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, component string")
    kept = shingle_join.one_of_each(docs.unionByName(docs.limit(20)))
    assert kept.columns == docs.columns
    want = sorted(i for i, (n, c) in _brute(rows).items() if c == i)
    got = sorted(r["doc_id"] for r in kept.collect())
    empty = {i for i, t in rows if not _set(t)}
    assert [i for i in got if i not in empty] == [i for i in want if i not in empty] and empty <= set(got)


def test_components(spark):
    rng = random.Random(0)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {i: i for p in pairs for i in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    loops = {a for a, b in pairs if a == b}
    assert got == {i: c for i, c in parent.items() if i in got} and set(parent) - set(got) <= loops
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0


def test_a_family_that_cannot_link_forms_no_pairs(spark):
    def left(n, at):
        rows = spark.range(5000).select(F.lit(7).alias("token"), F.col("id").alias("set"), (n + F.col("id") % 9).alias("n"), F.lit(at).alias("at"))
        return shingle_join._with_partners(rows.withColumn("band", shingle_join._size_band(90)), 90).count()

    # Eight in a hundred of their own stand before the template's token: at 90 per cent no two can link.
    assert left(500, 41) == 0 and left(500, 20) == 5000
    for percent in (1, 50, 80, 99):
        sizes = spark.range(1, 400).select(F.col("id").alias("n")).withColumn("band", shingle_join._size_band(percent))
        bands = {r.n: r.band for r in sizes.collect()}
        assert all(abs(bands[a] - bands[b]) <= 1 for a in bands for b in bands if 100 * min(a, b) >= percent * max(a, b))


def test_a_family_on_one_template_equals_all_pairs(spark):
    rng = random.Random(41)
    template = [f"w{i}" for i in range(110)]
    rows = []
    for i in range(120):
        own = [f"o{i}x{k}" for k in range(rng.choice([2, 5, 9, 12, 30]))]
        rows.append((i, " ".join(own + template if i % 2 else template + own)))
    for settings in (Settings(), Settings(words=5, percent=80), Settings(percent=100)):
        assert _ours(spark, rows, settings) == _brute(rows, settings)
