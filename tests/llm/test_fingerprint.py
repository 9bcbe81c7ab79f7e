"""Fingerprints against windows counted one by one, and neighbours against a sorted list."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logsluice.llm import fingerprint as fp
from logsluice.llm import neighbours, queries
from logsluice.llm.words import text_bytes

RNG = random.Random(11)


def _prose(n):
    return " ".join("".join(RNG.choice("aeinorst") for _ in range(RNG.randint(2, 8))) for _ in range(n))


def _ranks(texts):
    data, offsets = text_bytes(pa.array(texts))
    classes = fp.entropy_classes(data[offsets[0] : offsets[-1]])
    return fp.rarity_ranks(np.bincount(classes, minlength=fp.CLASSES + 1))


def test_entropy_of_each_window():
    text = (_prose(40) + "a" * 90 + "ÄÖÜ" * 30).encode() * 3
    got = fp.entropy_classes(np.frombuffer(text, np.uint8))
    for i in range(0, len(text) - 63, 7):
        counts = Counter(text[i : i + 64]).values()
        entropy = -sum(c / 64 * math.log2(c / 64) for c in counts)
        assert abs(got[i] - entropy / 6 * 1000) <= 1.001
    assert len(got) == len(text) - 63


def test_selection_is_the_leftmost_rarest_of_neighbourhoods():
    texts = ["", "short", _prose(100), "b" * 300, _prose(12)[:64], _prose(15)[:80], _prose(30)[:140], _prose(300)]
    ranks = _ranks(texts)
    data, offsets = text_bytes(pa.array(texts))
    row, hashes = fp.select_features(data, offsets, ranks)
    for r, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        classes = fp.entropy_classes(raw)
        popular = Counter()
        for i in range(max(len(classes) - 63, min(len(classes), 1))):
            near = range(i, min(i + 64, len(classes)))
            popular[min(near, key=lambda k: (ranks[classes[k]], k))] += 1
        popular = {k: v for k, v in popular.items() if classes[k] > fp.DULL}
        need = min(16, max(len(classes) - 63, 1))
        want = [k for k, v in popular.items() if v >= need] or [k for k, v in popular.items() if v == max(popular.values())][:1]
        distinct = {text.encode()[k : k + 64] for k in want}
        assert (row == r).sum() == (len(distinct) or bool(text)), text[:20]
        alone = fp.select_features(raw, np.array([0, len(raw)]), ranks)[1]
        assert alone.tolist() == hashes[row == r].tolist()


def test_likeness():
    a, b = _prose(3000), _prose(3000)
    ranks = _ranks([a, b])
    chain = {x: fp._chains(pa.array([x]), ranks)[0] for x in (a, b, a[:9000] + b[9000:], "", "x", "y", a[:200])}
    assert len(chain[a]) > 1 and all(fp.likeness(c, c) == 1 for c in chain.values())
    assert fp.likeness(chain[a], chain[b]) < 0.05
    mixed = fp.likeness(chain[a], chain[a[:9000] + b[9000:]])
    assert 0.25 < mixed < 0.8 and mixed == fp.likeness(chain[a[:9000] + b[9000:]], chain[a])
    assert fp.likeness(chain[""], chain["x"]) == 0 == fp.likeness(chain["x"], chain["y"])
    assert all((fp.from_text(fp.as_text(c)) == c).all() for c in chain.values())


def test_successors_for_any_number_of_ranges(spark):
    rows = [(i * i, f"t{i}") for i in range(200)] + [(4, "t2"), (4, "other"), (None, "n"), (None, None), (-9, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for n in (1, 2, 7, 60):
        got, follow = [], {}
        for part in neighbours.with_successors(docs, n).rdd.glom().collect():
            own = [(r["doc_id"], r["text"]) for r in part]
            pairs = [(a, b) for a, b, r in zip(own, own[1:], part, strict=False) if not r["ahead"]]
            got += [a for a, _ in pairs]
            for a, b in pairs:
                follow.setdefault(a, set()).add(b)
        want = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
        assert sorted(got, key=repr) == sorted(want, key=repr)
        for (i, t), after in follow.items():
            above = [x for x, _ in want if x is not None and x > (i if i is not None else -10)]
            allowed = {i, min(above) if above else None}
            assert {x for x, _ in after} <= allowed, (n, i, t, after)


def test_edited_texts(spark):
    texts = [_prose(200), "", None, "é" * 5, "x", _prose(20), _prose(20)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ahead int").repartition(3)
    got = {r["doc_id"]: r for r in fp.compare_with_edited(docs).collect()}
    for i, text in enumerate(texts):
        t, nxt = text or "", texts[(i + 1) % len(texts)] or ""
        want = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == "" and got[0]["near_edited"] > 0.2 > got[5]["near_next"]
    assert fp.compare_with_edited(docs.limit(0)).count() == 0
    one = fp.compare_with_edited(docs.where("doc_id = 0")).collect()[0]
    half = len(texts[0]) // 2
    assert one["edited_sha256"] == hashlib.sha256((texts[0][: len(texts[0]) - half] + texts[0][:half]).encode()).hexdigest()
    assert one["near_next"] == 1
    same = fp.fingerprints(spark.createDataFrame([(1, texts[0]), (2, texts[0])], "doc_id long, text string")).collect()
    assert same[0]["fingerprint"] == same[1]["fingerprint"] != ""


WORD = 1 << 64


def _plain_class(window):
    weight = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    most = round(64 * 6 * 65536)
    return (most - weight) * 1000 // most


def _plain_hash(raw):
    total, power = 0, 1
    for byte in raw:
        total = (total + int(fp._VALUES[byte]) * power) % WORD
        power = power * (0x9E3779B97F4A7C15 | 1) % WORD
    return total


def _plain_chain(text, ranks):
    """Filters as sets of bits, window by window."""
    raw = text.encode()
    if not raw:
        return []
    classes = [_plain_class(raw[i : i + 64]) for i in range(len(raw) - 63)]
    popular = Counter()
    for i in range(max(len(classes) - 63, min(len(classes), 1))):
        popular[min(range(i, min(i + 64, len(classes))), key=lambda k: (ranks[classes[k]], k))] += 1
    popular = {k: n for k, n in sorted(popular.items()) if classes[k] > 100}
    chosen = [k for k, n in popular.items() if n >= min(16, max(len(classes) - 63, 1))]
    if popular and not chosen:
        chosen = [max(popular, key=lambda k: (popular[k], -k))]
    found = [_plain_hash(raw[k : k + 64]) for k in chosen] or [(_plain_hash(raw) + len(raw)) % WORD]
    mixed = list(dict.fromkeys(int(fp.mix(np.array([h], np.uint64))[0]) for h in found))
    return [{(h >> 11 * k) % 2048 for h in mixed[i : i + 160] for k in range(5)} for i in range(0, len(mixed), 160)]


def _plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def one(x, y):
        shared, most = len(x & y), min(len(x), len(y))
        chance = len(x) * len(y) / 2048
        floor = chance + 0.3 * (most - chance)
        return 1.0 if shared == most else min(max((shared - floor) / (most - floor), 0.0), 1.0)

    def toward(x, y):
        return sum(max(one(f, g) for g in y) * len(f) for f in x) / sum(map(len, x))

    if len(a) == len(b):
        return (toward(a, b) + toward(b, a)) / 2
    return toward(*sorted((a, b), key=len))


def test_the_query_equals_fingerprints_made_window_by_window(spark, tmp_path):
    base = _prose(1800)
    texts = [base, base[:3000] + _prose(60), _prose(60), None, "", "é", "ab" * 200, "x" * 64, _prose(9)[:70], base[500:4000], base[500:3000], "ß" * 40 + _prose(40)]
    docs = spark.createDataFrame([(i * 3, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, n_chars int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id // 3: r for r in queries.op7_document_fingerprints(spark, str(tmp_path)).collect()}
    counts = Counter(_plain_class(raw[k : k + 64]) for t in texts for raw in [(t or "").encode()] for k in range(len(raw) - 63))
    ranks = {c: k for k, c in enumerate(sorted(range(1001), key=lambda c: (c <= 100, counts[c], c)))}
    whole = [t or "" for t in texts]
    after = whole[1:] + whole[:1]
    chains = [_plain_chain(t, ranks) for t in whole]
    assert max(map(len, chains)) > 1
    for i, (text, following) in enumerate(zip(whole, after, strict=True)):
        edited = _plain_chain(text[: len(text) - len(text) // 2] + following[: len(text) // 2], ranks)
        for name, chain in (("fingerprint", chains[i]), ("edited_fingerprint", edited)):
            bits = [set(np.flatnonzero(np.unpackbits(f.view(np.uint8), bitorder="little")).tolist()) for f in fp.from_text(got[i][name])]
            assert bits == chain, (i, name)
        assert math.isclose(got[i].near_edited, _plain_likeness(chains[i], edited), abs_tol=1e-9)
        assert math.isclose(got[i].near_next, _plain_likeness(chains[i], chains[(i + 1) % len(chains)]), abs_tol=1e-9)
