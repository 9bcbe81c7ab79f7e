"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from logsluice.llm import queries, spelling


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _expected(words, min_length=6, min_count=5, factor=5):
    counts = {w: n for w, n in Counter(words).items() if w and len(w) >= min_length and n >= min_count}
    near = {w: sorted((x for x in counts if _near(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: next((x for x in near[w][:1] if counts[x] >= factor * counts[w]), None) for w in counts}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def _got(frame):
    rows = frame.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def _frame(spark, words):
    return spark.createDataFrame([(w, "x") for w in words], "word string, list string").repartition(3)


def _edited(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind < 2) :]


@pytest.mark.parametrize(("letters", "rare"), [("ab", 1), ("ab", 64), ("abcdéÿñ", 2), ("abcdefghij", 8)])
def test_words_equal_the_comparison_of_all(spark, letters, rare):
    rng = random.Random(len(letters) + rare)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(60)]
    words = []
    for stem in stems:
        word, n = stem, 1500
        for _ in range(6):
            words += [word] * rng.randint(max(1, n // 2), n)
            word, n = _edited(rng, word, letters), max(4, n // 6)
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(4000)]
    want = _expected(words, min_count=3)
    assert sum(v[3] for v in want.values()) > 50 and any(v[0] and v[1] != v[0] for v in want.values())
    assert _got(spelling.variants(_frame(spark, words), spelling.Settings(min_count=3, rare=rare))) == want


def test_an_edit_changes_no_more_grams_than_the_bound():
    rng = random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(6, 10)))
        other = _edited(rng, word, "abc")
        if len(other) < 6 or word == other:
            continue
        frequent = {"".join(rng.choice("abc") for _ in range(n)) for n in (2, 2, 2, 3, 3, 4, 5)}
        frequent |= {g[:k] for g in frequent for k in range(2, len(g))}

        def grams(w):
            marked = spelling.START + w + spelling.END
            for p in range(len(marked) - 1):
                size = next((n for n in range(2, 7) if p + n >= len(marked) or n == 6 or marked[p : p + n] not in frequent))
                yield p, size, zlib.crc32(marked[p : p + size].encode()) % 5

        sides = []
        for w in (word, other):
            marked = spelling.START + w + spelling.END
            ends, starts = spelling.merged_lists(w, list(grams(w)))
            sides.append({marked[:e] for e in ends} | {(marked[s:],) for s in starts})
        assert sides[0] & sides[1], (word, other)


def test_odd_words(spark):
    long = "a" * 30_000
    words = [None, "", "short", "sechzig", *["almost"] * 4, *[long] * 5, *["b" + long] * 30, *["c" + long] * 31, *["straße"] * 5, *["strasse"] * 25, *["STRASSE"] * 5]
    assert _got(spelling.variants(_frame(spark, words))) == _expected(words)
    assert spelling.variants(_frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.Settings(min_length=5)


def test_the_query_reads_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    known = ["Letter", "lettre", "Übung", "ÜBUNGEN", "übungen", "naïveté", "plain×words÷here", "sentence", "sentences"]
    texts = [" ".join(rng.choice(known) + rng.choice(["", ".", "-x", "9", "\n"]) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[1]), (50, None), (51, ""), (52, "letters " * 50_000)]
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id long, text string, run string, h int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    words = []
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run)
    got = _got(queries.op12_spelling_variants(spark, str(tmp_path)))
    assert got == _expected(words) and len(got) > 5
