"""Personal data against plain patterns and a graph held in dictionaries."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from logsluice.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _base(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if _valid(kind, m[0])]
    return sorted(found)


def _card(rng, n=16):
    body = [rng.randint(0, 9) for _ in range(n - 1)]
    return next(x for d in range(10) if _valid("card", x := "".join(map(str, body)) + str(d)))


PIECES = [" ", "-", ".", "+", "@", "(", ")", "1", "23", "255", "256", "4111 1111 1111 1111", "a.b", "x@y.z", "é", "+49 (170)", "127.0.0.1", "\n", "word", "_", "%"]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["a@b.c@d.e", "a@b..c a@b.c-", "1.2.3.4.5.6.7.8.9", "0001.02.255.0", "1.2.3.256 1.2.3.4", "+1 (017) 555-7713", "+12 3", "4012-8888-8888-1881", "é@b.de", "x%+-@a-.b"]
    for text in texts:
        assert [(a, k, b) for a, b, k in pii.base_spans(text)] == _base(text), text


def test_identifiers_are_tokens_of_digits_outside_known_spans():
    def found(text, digits=5):
        return [text[a:b] for a, b in pii.identifiers(text, pii.base_spans(text), digits)]

    assert found("id X1234567, no. 12-34-5678. v2.0 and 555-1234; 10.0.0.1 a@b99999.c") == ["X1234567", "12-34-5678", "555-1234"]
    assert found("--/12345/-- 1 2 3 4 5x 99999é 0123456789abcdef") == ["12345", "1 2 3 4", "99999", "0123456789abcdef"][:1] + ["99999", "0123456789abcdef"]
    assert found("") == [] and found("no digits") == []
    text = "a1" * 300_000 + " " + "1." * 300_000 + "@" * 300_000 + "+" * 300_000 + "1-" * 300_000 + "x" * 600_000
    assert len(found(text)) <= 3


def _brute(texts, settings):
    """Spans of each text from dictionaries, step by step."""
    places, edges = [], set()
    for i, text in enumerate(texts):
        base = _base(text)
        spans = [(a, b, k) for a, k, b in base]
        things = spans + [(a, b, None) for a, b in pii.identifiers(text or "", spans, settings.digits)]
        for a, b, k in things:
            for p in pii.patterns(text, a, b, settings.reach):
                edges.add((p, (k, text[a:b])))
                if k is None:
                    places.append((i, a, b, p))
    of_pattern, of_thing = defaultdict(set), defaultdict(set)
    for p, thing in edges:
        of_pattern[p].add(thing)
        of_thing[thing].add(p)
    worth = {t: [float(t[0] == k) for k in range(4)] for t in of_thing}
    for step in range(settings.rounds):
        score = {p: [sum(worth[t][k] for t in ts) / (len(ts) + 1) for k in range(4)] for p, ts in of_pattern.items()}
        if step < settings.rounds - 1:
            worth |= {t: [sum(score[p][k] for p in ps) / len(ps) for k in range(4)] for t, ps in of_thing.items() if t[0] is None}
    good = {}
    for p, s in score.items():
        fit = [(s[k], -k) for k in range(4) if s[k] >= settings.least and sum(t[0] == k for t in of_pattern[p]) >= settings.support]
        if fit:
            good[p] = max(fit)
    added = defaultdict(dict)
    for i, a, b, p in places:
        if p in good:
            added[i][a, b] = max(added[i].get((a, b), (0.0, 0)), good[p])
    names = [*pii.KINDS, *pii.FOUND]
    return [
        ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(_base(t) + [(a, 4 - k, b) for (a, b), (_, k) in added[i].items()]))
        for i, t in enumerate(texts)
    ]


def _texts(rng):
    words = ["of", "from", "the", "and", "was", "with", "über"]
    texts = []
    for _ in range(400):
        parts = rng.choices(words, k=rng.randint(3, 12))
        for _ in range(rng.randint(0, 3)):
            card = _card(rng) if rng.random() < 0.9 else "".join(rng.choices("0123456789", k=16))
            phone = f"+49 {rng.randint(10**8, 10**9)}" if rng.random() < 0.85 else f"0{rng.randint(10**8, 10**9)}"
            said = [f"Card number {card}", f"call us: {phone}", f"mail me at u{rng.randint(1, 99)}@x.org", f"order {rng.randint(10**6, 10**7)}", f"host 10.0.{rng.randint(0, 255)}.7 up", f"the {rng.choice([card, phone, 123456])}"]
            parts.insert(rng.randint(0, len(parts)), rng.choice(said))
        texts.append(" ".join(parts))
    texts += [texts[0]] * 50 + ["", None, "card number 1234567890123456", "order 7654321 order 1234567"]
    return texts


def test_the_query_equals_the_graph_in_dictionaries(spark, tmp_path):
    texts = _texts(random.Random(4))
    rows = [(i if i % 50 else None, t, "x", 1, "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, row int, pattern string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_pii(spark, str(tmp_path)).collect()
    want = _brute(texts, pii.Settings())
    assert sorted((r.doc_id or -1, r.spans) for r in rows) == sorted((i if i % 50 else -1, s) for i, s in enumerate(want))
    spans = {r.doc_id: r.spans for r in rows}
    last = len(texts) - 1
    # No valid card, but where cards stand; a number behind "order" is nobody's.
    assert spans[last - 1] == "like_card:12:28" and spans[last] == ""
    assert "like_phone" in ",".join(spans.values())
    for row in rows:
        if row.doc_id is not None:
            base = _base(texts[row.doc_id])
            assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
            listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_copies_and_chance_are_no_evidence(spark):
    copies = [f"seen {_card(random.Random(1))} here"] * 100 + ["seen 1234567 here"]
    mixed = [f"value {x} end" for x in ("1.2.3.4", "5.6.7.8", "9.9.9.9", "123456", "234567", "345678")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(copies + mixed)], "doc_id long, text string")
    rows, good = pii.find(docs)
    assert good.count() == 0 and rows.agg(F.sum("n_found")).first()[0] == 0


def test_reliability_spreads_from_found_things(spark):
    cards = [_card(random.Random(i)) for i in range(12)]
    texts = [f"my card {c} ok" for c in cards] + ["my card 1234123412341234 ok", "code 1234123412341234"] + [f"code {c}" for c in cards[:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (1, 4):
        settings = pii.Settings(rounds=rounds)
        rows, _ = pii.find(docs, settings=settings)
        assert [r.spans for r in rows.orderBy("doc_id").collect()] == _brute(texts, settings)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string").limit(0)
    rows, good = pii.find(docs)
    assert rows.count() == 0 and good.count() == 0
