"""Licence scans: matching statistics of texts against a suffix automaton of licence words.

One automaton holds all templates. A text's words are looked up in the templates' vocabulary as
arrays; only stretches in which every pair of neighbours occurs in some template, which no match
of two words can leave, are streamed through the automaton. Matches that cannot be made longer at
their place in a template, of which it may hold several, are chained where they go forward in
both the text and the template; the chains that cover most of it, from which labels and scores
follow, are found by dynamic programming.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.words import NOT_ALPHANUMERIC, Words, row_groups, split_words, text_bytes

# Phrases that are looked for as they are, and the texts of public licences.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
)


@dataclass(frozen=True)
class Settings:
    """``shortest``: words of a match; ``gap``: words of the text between matches of a chain;
    ``covered``: the part of a template from which its label is given."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    shortest: int = 4
    gap: int = 20
    covered: float = 0.8


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, int] = field(default_factory=dict)  # by template: where the words first end
    places: set[tuple[int, int]] = field(default_factory=set)  # template, end: everywhere the words end


class SuffixAutomaton:
    """All runs of words of several sequences; each state knows where it ends in each of them."""

    def __init__(self, sequences: list[list[int]]):
        self.states = [State(0)]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.states[last].ends.setdefault(number, at + 1)
                self.states[last].places.add((number, at + 1))
        for state in sorted(self.states[1:], key=lambda s: -s.length):
            above = self.states[state.link].ends
            for number, end in state.ends.items():
                above[number] = min(end, above.get(number, end))
            self.states[state.link].places |= state.places

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].next:
            known = states[last].next[word]
            if states[known].length == states[last].length + 1:
                return known
            return self._split(last, word, known)
        made = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].next:
            states[at].next[word] = made
            at = states[at].link
        if at < 0:
            states[made].link = 0
            return made
        known = states[at].next[word]
        fits = states[known].length == states[at].length + 1
        states[made].link = known if fits else self._split(at, word, known)
        return made

    def _split(self, at: int, word: int, known: int) -> int:
        states = self.states
        copy, old = len(states), states[known]
        states.append(State(states[at].length + 1, old.link, dict(old.next), dict(old.ends)))
        old.link = copy
        while at >= 0 and states[at].next.get(word) == known:
            states[at].next[word] = copy
            at = states[at].link
        return copy

    def statistics(self, words: Iterator[int]) -> Iterator[tuple[int, int]]:
        """At each word, the length of the longest run of the sequences that ends there, and its state."""
        at, length = 0, 0
        for word in words:
            while at and word not in self.states[at].next:
                at = self.states[at].link
                length = self.states[at].length
            if word in self.states[at].next:
                at, length = self.states[at].next[word], length + 1
            yield length, at


def _words_of(texts: list[str]) -> tuple[Words, np.ndarray]:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    return split_words(data, offsets, NOT_ALPHANUMERIC), data


class Scanner:
    """The compiled templates and phrases."""

    def __init__(self, settings: Settings):
        self._s = settings
        texts = [text for _, text in settings.templates] + [phrase for phrase, _ in settings.phrases]
        words, _ = _words_of(texts)
        self._vocabulary = np.unique(words.hashes)
        ids = np.searchsorted(self._vocabulary, words.hashes)
        sequences = [ids[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        n = len(settings.templates)
        self._phrases = [(s, label) for s, (_, label) in zip(sequences[n:], settings.phrases, strict=True)]
        self._sizes = [len(s) for s in sequences[:n]]
        self._labels = [label for label, _ in settings.templates]
        self._sequences = [s.tolist() for s in sequences[:n]]
        self._automaton = SuffixAutomaton(self._sequences)
        self._held: dict[int, list[tuple[int, int, int, int]]] = {}
        self._pairs = np.zeros((len(self._vocabulary) + 1,) * 2, dtype=bool)
        for s in sequences[:n]:
            self._pairs[s[:-1], s[1:]] = True
        self._may_be = np.zeros(1 << 16, dtype=bool)
        self._may_be[self._vocabulary >> np.uint64(48)] = True

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids; other words have the next id after the last."""
        ids = np.full(len(hashes), len(self._vocabulary))
        likely = np.flatnonzero(self._may_be[hashes >> np.uint64(48)])
        place = np.searchsorted(self._vocabulary[:-1], hashes[likely])
        found = self._vocabulary[place] == hashes[likely]
        ids[likely[found]] = place[found]
        return ids

    def phrases(self, ids: np.ndarray, last_of_row: np.ndarray) -> list[np.ndarray]:
        """For each phrase, where its words stand in a row."""
        found = []
        for phrase, _ in self._phrases:
            at = np.flatnonzero(ids == phrase[0])
            at = at[at + len(phrase) <= last_of_row[at]]
            for k in range(1, len(phrase)):
                at = at[ids[at + k] == phrase[k]]
            found.append(at)
        return found

    def stretches(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Maximal ranges of words, ``shortest`` at least, all of whose neighbours are known pairs."""
        if len(ids) < 2:
            return []
        linked = self._pairs[ids[:-1], ids[1:]]
        inner = first[(first > 0) & (first < len(ids))]
        linked[inner - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2] + 1
        long = ends - starts >= self._s.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def _places(self, state: int) -> list[tuple[int, int, int, int]]:
        """Where the words of a state, or a suffix of ``shortest`` words at least, end: template, end in
        it, the template's next word (-2: none), and the length of the longest such suffix."""
        if state not in self._held:
            states, found, seen, at = self._automaton.states, [], set(), state
            while at >= 0 and states[at].length >= self._s.shortest:
                for t, end in sorted(states[at].places - seen):
                    after = self._sequences[t][end] if end < self._sizes[t] else -2
                    found.append((t, end, after, states[at].length))
                seen, at = states[at].places, states[at].link
            self._held[state] = found
        return self._held[state]

    def matches(self, ids: np.ndarray, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """Matches that no word before or after extends, at every place of a template: template,
        end in it, end in the text, words."""
        found, words = [], ids[start:end].tolist()
        for k, (length, state) in enumerate(self._automaton.statistics(words)):
            if length >= self._s.shortest:
                after = words[k + 1] if k + 1 < len(words) else -1
                found += [(t, e, start + k + 1, min(length, most)) for t, e, known, most in self._places(state) if known != after]
        return found

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Template, first and last word in the text (from, to), and template words covered.

        A match may follow one of its template that ends before it in the template and in the text,
        there at most ``gap`` words before it starts; it adds its words behind both ends. Of all
        chains, those that cover most are taken first, each match in one; what lies within a chain
        that covers as much is left out.
        """
        of_template: dict[int, list[tuple[int, int, int]]] = {}
        for template, end, at, length in sorted(matches, key=lambda m: (m[2], m[1])):
            of_template.setdefault(template, []).append((end, at, length))
        return sorted((t, *chain) for t, found in of_template.items() for chain in self._chains(found))

    def _chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Chains of one template's matches (end in it, end in the text, words), sorted by the end in the text."""
        best, first, before = [], [], []
        for k, (end, at, length) in enumerate(found):
            most, back = (length, at - length), -1
            for j in range(k - 1, -1, -1):
                earlier, text_end, _ = found[j]
                if at - length - text_end > self._s.gap:
                    break
                if earlier < end and text_end < at:
                    joined = best[j] + min(length, end - earlier, at - text_end), first[j]
                    if joined > most:
                        most, back = joined, j
            best.append(most[0])
            first.append(most[1])
            before.append(back)
        used, taken = [False] * len(found), []
        for last in sorted(range(len(found)), key=lambda k: (-best[k], k)):
            if used[last]:
                continue
            head = last
            used[head] = True
            while before[head] >= 0 and not used[before[head]]:
                head = before[head]
                used[head] = True
            _, at, length = found[head]
            taken.append((at - length, found[last][1], best[last] - best[head] + length))
        kept, near = [], []
        for chain in sorted(taken, key=lambda c: (c[0], -c[1], -c[2])):
            near = [c for c in near if c[1] > chain[0]]
            if not any(c[1] >= chain[1] and c[2] >= chain[2] for c in near):
                near.append(chain)
                kept.append(chain)
        return kept

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        """Columns of the result, row by row."""
        words = split_words(data, offsets, NOT_ALPHANUMERIC)
        sizes = np.diff(words.first)
        n = len(sizes)
        ids, rows = self._ids(words.hashes), words.rows()
        last_of_row = np.repeat(words.first[1:], sizes)
        base = self.phrases(ids, last_of_row)
        places = np.concatenate(base) if base else np.zeros(0, np.int64)
        within = places - words.first[rows[places]]
        lowest, highest = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(lowest, rows[places], within)
        np.maximum.at(highest, rows[places], within)
        base_labels: list[set[str]] = [set() for _ in range(n)]
        for at, (_, label) in zip(base, self._phrases, strict=True):
            for row in np.unique(rows[at]).tolist():
                base_labels[row].add(label)
        matched: dict[int, list] = {}
        for start, end in self.stretches(ids, words.first):
            matched.setdefault(int(rows[start]), []).extend(self.matches(ids, start, end))
        labels, scores = [set(x) for x in base_labels], [float(bool(x)) for x in base_labels]
        spans: list[list[dict]] = [[] for _ in range(n)]
        for row, found in matched.items():
            origin = int(words.first[row])
            for template, start, end, covered in self.chains(found):
                part = covered / self._sizes[template]
                scores[row] = max(scores[row], part)
                if part >= self._s.covered:
                    labels[row].add(self._labels[template])
                spans[row].append({"label": self._labels[template], "template": template, "start": start - origin, "end": end - origin, "covered": part})
        none = highest < 0
        joined = lambda sets: [",".join(sorted(x)) for x in sets]
        return {
            "n_words": sizes.tolist(),
            "n_base": np.bincount(rows[places], minlength=n).tolist(),
            "first_word": pa.array(lowest, mask=none),
            "last_word": pa.array(highest, mask=none),
            "base_labels": joined(base_labels),
            "labels": joined(labels),
            "score": scores,
            "spans": spans,
        }


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, template: int, start: long, end: long, covered: double>>"
)


@lru_cache(maxsize=4)
def _scanner(settings: Settings) -> Scanner:
    return Scanner(settings)


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per document; no shuffle.

    ``n_base``, ``first_word`` and ``last_word`` count the phrases' places, from word 0; without
    any the latter two are null. ``labels`` has the phrases' labels and those of templates that
    a chain covers far enough. ``score`` is 1 with a phrase, else the largest part of a template
    that a chain covers. A null text is empty and has no words; rows are independent, so
    repeated ones have equal results. Words are compared by 64-bit hashes.
    """
    result_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(settings)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                columns = scanner(data, offsets[lo : hi + 1])
                columns["spans"] = pa.array(columns["spans"], result_type)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo)} | columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, RESULT)
