"""Spelling variants: words at one edit from each other, found by grams of variable length.

Words stand between two marks. Grams of SHORTEST characters that are frequent in the vocabulary
are extended, character by character, until they are rare or LONGEST characters long; what was
frequent is the pruned dictionary, and a word's gram at a place is the shortest string from there
on that is not in it. Which gram that is depends on its own characters alone, so an edit changes
just the grams over its place. A word's bound is the largest number of grams over one of its
characters: all but so many are also grams of any word one edit away. Therefore two such words
share one of the ``bound + 1`` rarest grams of each, and only those lists are merged. Beside a
shared gram, everything on the side without the edit is equal, too; lists are kept by that text
and by the word's size, so that a frequent gram is not one list. What meets in a list is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.scale import saved

SHORTEST, LONGEST = 2, 6
START, END = "\x02", "\x03"
#: Rows of an Arrow batch; a long word has as many grams as characters.
ROWS = 1 << 15


@dataclass(frozen=True)
class Settings:
    """Words of ``min_length`` characters that occur ``min_count`` times; a form occurs ``factor`` times as often.

    Grams are extended while they occur more than ``rare`` times in the vocabulary.
    """

    min_length: int = 6
    min_count: int = 5
    factor: int = 5
    rare: int = 64

    def __post_init__(self):
        if self.min_length + len(START + END) + 1 - SHORTEST <= LONGEST:
            raise ValueError("an edit could change every gram of so short a word")


def runs(docs: DataFrame, *keep: str, text: str = "text", letters: str = r"A-Za-zÀ-ÿ", min_length: int = 6) -> DataFrame:
    """Maximal runs of ``letters`` in whole texts as ``run`` beside ``keep``; A-Z are lower-cased, short runs left out.

    A null text has none. Only the named columns are read.
    """
    words = docs.select(*keep, F.explode(F.split(F.col(text).cast("string"), f"[^{letters}]+")).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length("run") == F.char_length("run")
    folded = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", upper, upper.lower()))
    return words.where(F.char_length("run") >= min_length).withColumn("run", folded)


def without_character(run: Column, at: Column) -> Column:
    return F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))


def vocabulary(words: DataFrame, settings: Settings) -> DataFrame:
    """Stored: ``word``, ``n`` occurrences and an ``id`` of the words of ``words`` that are long and frequent enough."""
    long_enough = words.where(F.char_length("word") >= settings.min_length)
    counts = long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= settings.min_count)
    return saved(counts.withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each place of a word, as many characters as a gram may have."""

    def batch(ids: list, places: list, grams: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(grams, pa.string())], ["id", "place", "window"])

    ids, places, grams = [], [], []
    for rows in batches:
        for key, word in zip(rows.column("id").to_pylist(), rows.column("word").to_pylist(), strict=True):
            marked = START + word + END
            for p in range(len(marked) - SHORTEST + 1):
                ids.append(key)
                places.append(p)
                grams.append(marked[p : p + LONGEST])
                if len(ids) >= ROWS:
                    yield batch(ids, places, grams)
                    ids, places, grams = [], [], []
    if ids:
        yield batch(ids, places, grams)


def _chosen(windows: DataFrame, rare: int) -> DataFrame:
    """With each distinct window the ``size`` of its gram and how often that occurs."""
    distinct = windows.groupBy("window").agg(F.count("*").alias("n"))
    sizes = F.sequence(F.lit(SHORTEST), F.char_length("window"))
    starts = distinct.select("window", "n", F.explode(sizes).alias("size")).withColumn("gram", F.left("window", "size"))
    counts = starts.groupBy("gram").agg(F.sum("n").alias("occurs"))
    of_size = F.struct("size", "occurs")
    found = starts.join(counts, "gram").groupBy("window").agg(
        F.coalesce(F.min(F.when(F.col("occurs") <= rare, of_size)), F.max(of_size)).alias("gram")
    )
    return found.select("window", "gram.size", "gram.occurs")


def merged_lists(word: str, grams: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Ends and starts, in the marked word, of the grams whose lists the word is in.

    ``grams`` are (place, size, occurrences). Equal grams are chosen together. Of them the first tells what
    stands before an edit behind it, and the last what stands behind an edit before it: where another
    one of them is untouched on that side, these are, too.
    """
    marked = START + word + END
    over = np.zeros(len(marked) + 1, dtype=np.int64)
    for place, size, _ in grams:
        over[place] += 1
        over[place + size] -= 1
    bound = int(np.cumsum(over)[1:-2].max())
    ranked = sorted((occurs, marked[place : place + size], place) for place, size, occurs in grams)
    last = ranked[bound][:2]
    kept = [(gram, place) for occurs, gram, place in ranked if (occurs, gram) <= last]
    ends = {place + len(gram) for gram, place in dict(reversed(kept)).items()}
    return sorted(ends), sorted(dict(kept).values())


def _hashes(text: str, sizes: list[int], seed: int) -> list[int]:
    """Of the first so many characters each, in one pass."""
    state, found, done = xxhash.xxh64(seed=seed), [], 0
    for size in sizes:
        state.update(text[done:size].encode())
        done = size
        found.append(state.intdigest())
    return found


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists each word is in: by the text up to a gram's end, and by that from its start on."""
    for rows in batches:
        keys, words, counts = [], [], []
        for row in rows.to_pylist():
            marked = START + row["word"] + END
            ends, starts = merged_lists(row["word"], [(g["place"], g["size"], g["occurs"]) for g in row["grams"]])
            found = _hashes(marked, ends, 1) + _hashes(marked[::-1], [len(marked) - p for p in reversed(starts)], 2)
            keys += found
            words += [row["word"]] * len(found)
            counts += [row["n"]] * len(found)
        arrays = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(words, pa.string()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["list", "word", "n"])


def near_words(words: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of ``words`` (word, n, id) at exactly one insertion, deletion or replacement, once each: ``a``, ``n_a``, ``b``, ``n_b``."""
    windows = words.select("id", "word").mapInArrow(_windows, "id long, place int, window string")
    placed = windows.join(_chosen(windows, settings.rare), "window")
    grams = placed.groupBy("id").agg(F.collect_list(F.struct("place", "size", "occurs")).alias("grams"))
    lists = saved(grams.join(words, "id").select("word", "n", "grams").mapInArrow(_lists, "list long, word string, n long"), "lists")
    size = F.char_length("word")
    left = lists.select("list", F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(size, size + 1)).alias("size"))
    right = lists.select("list", F.col("word").alias("b"), F.col("n").alias("n_b"), size.alias("size"))
    met = left.join(right, ["list", "size"]).where((F.char_length("a") < F.col("size")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each word of ``words`` (one row per occurrence).

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them, the first
    in code-point order among equals, if it occurs ``factor`` times as often, else null; ``root``
    is where forms lead to in the end, the word itself without one. Null and short words count
    for nothing; without words there are no rows. Words are compared whole, however long; two that
    may be near take time by the product of their lengths.
    """
    known = vocabulary(words, settings)
    pairs = saved(near_words(known, settings), "pairs")
    both = pairs.select("a", "b", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word"))).alias("best")
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    joined = known.select("word", "n").join(near, "word", "left")
    frequent = -F.col("best.n") >= settings.factor * F.col("n")
    found = saved(
        joined.select(
            "word",
            F.when(frequent, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found, settings)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame, settings: Settings) -> DataFrame:
    """Where the forms of words that have one lead to, each step twice as far as the one before.

    A form is ``factor`` times as frequent as its word, which bounds the length of a chain.
    """
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = math.log(max(found.agg(F.max("n")).first()[0] or 1, 1), settings.factor) + 1
    for _ in range(math.ceil(math.log2(steps)) if settings.factor > 1 else 0):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = saved(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links
