"""Licence scans against searches in lists of words."""

import random
import re

from logsluice.llm import licences

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return [w.decode() for w in WORD.findall((text or "").encode().lower())]


def _base(words):
    found = [(i, label) for phrase, label in licences.PHRASES.items() for p in [phrase.split()]
             for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_matching_statistics_are_the_longest_suffixes():
    rng = random.Random(7)
    for _ in range(60):
        sequences = [[rng.randint(0, 2) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        text = [rng.randint(0, 3) for _ in range(30)]
        automaton = licences.SuffixAutomaton(sequences)
        for k, (length, state) in enumerate(automaton.statistics(text), 1):
            want = max(n for n in range(k + 1) if tuple(text[k - n : k]) in runs)
            assert length == want
            if length:
                run = text[k - length : k]
                ends = {t: next(e for e in range(length, len(s) + 1) if s[e - length : e] == run)
                        for t, s in enumerate(sequences) if tuple(run) in {tuple(s[i : i + length]) for i in range(len(s))}}
                assert automaton.states[state].ends == ends


def test_base_columns_of_nasty_texts(spark):
    apache = dict(licences.TEMPLATES[::-1])["apache"]
    texts = [None, "", "MIT License", "mit\nLICENSE mit-license", "MIT licenses", "xmit license", "mit é license",
             "general public license general public license", f"a {apache} b", "mit", "license", "the mit " * 100_000 + "license",
             "Released under the\tMIT License.", "Apache License MIT License", "licensed under cc by-nc 4.0"]
    docs = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in licences.scan(docs.repartition(2)).collect()}
    for i, text in enumerate(texts):
        words = _words(text)
        assert (got[i]["n_words"], *(got[i][c] for c in ("n_base", "first_word", "last_word", "base_labels"))) == (len(words), *_base(words)), text
        assert 0 <= got[i]["score"] <= 1 and set(got[i]["base_labels"].split(",")) - {""} <= set(got[i]["labels"].split(","))
    assert got[8]["labels"] == "apache" and got[14]["labels"] == "cc-by-nc" and got[14]["score"] == 1
    assert licences.scan(docs.limit(0)).count() == 0


def test_a_changed_licence_is_covered_by_a_chain(spark):
    label, text = licences.TEMPLATES[6]
    words = text.split()
    words[10:11] = ["entirely", "different"]
    del words[30]
    docs = spark.createDataFrame([(1, "before it " + " ".join(words) + " after"), (2, " ".join(text.split()[:12]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert got[1]["labels"] == label == "bsd" and 0.8 < got[1]["score"] < 1
    best = max(got[1]["spans"], key=lambda s: s["covered"])
    assert best["start"] == 2 and best["end"] == len(_words(" ".join(words))) + 2
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.5


def test_a_run_that_a_template_holds_twice_stays_in_its_chain(spark):
    words = _words(licences.TEMPLATES[6][1])
    at = words.index("reproduce")
    assert words[at + 1 : at + 13] == words[27:39] and words[at + 13] == "in"
    words[at] = words[at + 13] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = licences.scan(docs).collect()[0]
    assert got["labels"] == "bsd" and got["score"] == 66 / 68
    assert [(s["start"], s["end"]) for s in got["spans"] if s["label"] == "bsd"] == [(0, 68)]


def _most_covered(template, text, shortest, gap):
    """The best chain of matches that cannot be made longer, by trying all pairs."""
    matches = []
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= shortest:
                    matches.append((i + n, j + n, n))
    best = {}
    for at, end, n in sorted(matches):
        follows = [best[m] + min(n, end - m[1], at - m[0]) for m in best if m[0] < at and m[1] < end and at - n - m[0] <= gap]
        best[at, end, n] = max([n, *follows])
    return max(best.values(), default=0)


def test_chains_cover_as_much_as_trying_all_matches():
    rng = random.Random(11)
    for _ in range(150):
        names = ["aa", "bb", "cc", "dd"][: rng.randint(2, 4)]
        templates = [[rng.choice(names) for _ in range(rng.randint(4, 14))] for _ in range(3)]
        settings = licences.Settings(tuple((str(k), " ".join(t)) for k, t in enumerate(templates)), (), 2, 3, 0.8)
        text = [w for _ in range(3) for w in rng.choice(templates)] + [rng.choice(names) for _ in range(4)]
        text = [rng.choice([*names, "other"]) if rng.random() < 0.15 else w for w in text]
        raw = " ".join(text).encode()
        got = licences.Scanner(settings)(licences.np.frombuffer(raw, licences.np.uint8), licences.np.array([0, len(raw)]))
        wanted = [_most_covered(t, text, 2, 3) / len(t) for t in templates]
        for k, part in enumerate(wanted):
            assert max((s["covered"] for s in got["spans"][0] if s["template"] == k), default=0) == part
        assert got["score"][0] == max(wanted)
        assert got["labels"][0] == ",".join(str(k) for k, part in enumerate(wanted) if part >= 0.8)
