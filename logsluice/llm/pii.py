"""Personal data: what formats tell, and what bootstrapped contexts find beside it.

Matches of four formats are the base, and the seeds. A find is a seed, or an identifier: a token of
some digits that no format knows. The words around a find are its lexical patterns. Patterns and
distinct finds form a graph, on which reliability goes back and forth: a pattern is worth the
share of a kind among its finds, an unknown identifier the mean worth of its patterns. Patterns that are reliable
after the last round, and have enough distinct seeds of their kind, tell which unknown identifiers
are personal data. Copies of a text add nothing, as finds count once a pattern.

Texts are read once. What is kept of them, and what moves between tasks, are finds with their
context words; the finds themselves are kept as hashes only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.scale import saved
from logsluice.llm.words import byte_set, release_memory, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that contexts find.
FOUND = tuple(f"like_{k}" for k in KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Only at the start of a run of digits, where alone it can match: each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/-")
_IDENTIFIER = re.compile(r"[0-9]+(?:[ -][0-9]+)+(?![A-Za-z0-9])|[A-Za-z0-9](?:[A-Za-z0-9._/-]*[A-Za-z0-9])?")
_WORD = re.compile(r"[^\W\d_]+")

_IS_DIGIT, _IS_AT = byte_set((0x30, 0x39)), byte_set((0x40, 0x40))


@dataclass(frozen=True)
class Settings:
    """Identifiers of ``digits`` digits; contexts of the words in ``reach`` characters before and after.

    A pattern is reliable from ``least`` on, with ``support`` distinct seeds of its kind, after ``rounds``.
    """

    digits: int = 5
    reach: int = 60
    rounds: int = 3
    least: float = 0.7
    support: int = 3


Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one @ each; nothing but the run before it and the names after it matter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (names := _DOMAIN.match(text, at + 1)):
            done = names.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Start, end and number of the kind, by start and then kind; positions are code points."""
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def identifiers(text: str, known: list[Span], digits: int) -> Iterator[tuple[int, int]]:
    """Tokens of at least so many digits that overlap no known span."""
    taken, at, done = sorted((a, b) for a, b, _ in known), 0, 0
    for run in _DIGITS.finditer(text):
        start = run.start()
        if start < done:
            continue
        while start > done and text[start - 1] in _INSIDE:
            start -= 1
        while text[start] in "._/-":
            start += 1
        token = _IDENTIFIER.match(text, start)
        done = token.end()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        free = at == len(taken) or taken[at][0] >= done
        if free and len(_NOT_DIGITS.sub("", token[0])) >= digits:
            yield start, done


def patterns(text: str, start: int, end: int, reach: int) -> list[str]:
    """The find's place shown as _ : behind the last word, behind the last two, and between two words."""
    left = [w.lower() for w in _WORD.findall(text[max(0, start - reach) : start])[-2:]]
    if not left:
        return []
    made = [f"{left[-1]} _"]
    if len(left) == 2:
        made.append(f"{left[0]} {left[1]} _")
    if right := _WORD.search(text[end : end + reach]):
        made.append(f"{left[-1]} _ {right[0].lower()}")
    return made


_FIND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("thing", pa.int64()), ("patterns", pa.list_(pa.string()))])
_READ = pa.schema([("row", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("finds", pa.list_(_FIND))])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _finds(text: str, settings: Settings) -> tuple[list[Span], list[dict]]:
    base = base_spans(text)
    unknown = [(a, b, None) for a, b in identifiers(text, base, settings.digits)]
    made = []
    for a, b, kind in [*base, *unknown]:
        thing = xxhash.xxh64_intdigest(f"{'' if kind is None else kind}:{text[a:b]}") - (1 << 63)
        made.append({"start": a, "end": b, "kind": kind, "thing": thing, "patterns": patterns(text, a, b, settings.reach)})
    return base, made


def _reading(settings: Settings):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            few = [np.searchsorted(np.flatnonzero(flags[data]), offsets) for flags in (_IS_DIGIT, _IS_AT)]
            # No format and no identifier has neither an @ nor four digits.
            looked_at = (np.diff(few[0]) >= min(4, settings.digits)) | (np.diff(few[1]) > 0)
            rows = []
            for i, row in enumerate(batch.column("row").to_pylist()):
                base, finds = [], []
                if looked_at[i]:
                    base, finds = _finds(data[offsets[i] : offsets[i + 1]].tobytes().decode(), settings)
                counts = {f"n_{k}": sum(s[2] == n for s in base) for n, k in enumerate(KINDS)}
                rows.append({"row": row, **counts, "base_sha256": hashlib.sha256(_listed(base).encode()).hexdigest(), "finds": finds})
            yield pa.RecordBatch.from_pylist(rows, _READ)
            release_memory()

    return read


def _of(kind: int) -> str:
    return f"of_{KINDS[kind]}"


def pattern_scores(edges: DataFrame, settings: Settings) -> DataFrame:
    """Patterns with ``of_<kind>``, their reliability for each kind, and ``seeds_<kind>``, their distinct seeds.

    ``edges`` are distinct (pattern, thing, kind), the kind null for unknown things. Reliability is
    a mean over a pattern's things and one unreliable thing more.
    """
    kinds = range(len(KINDS))
    seeds = edges.where("kind IS NOT NULL").select("pattern", "kind", *((F.col("kind") == k).cast("double").alias(_of(k)) for k in kinds))
    unknown = edges.where("kind IS NULL").select("pattern", "thing")
    counted = [F.count_if(F.col("kind") == k).alias(f"seeds_{KINDS[k]}") for k in kinds]

    def scored(things: DataFrame) -> DataFrame:
        worth = [(F.sum(_of(k)) / (F.count("*") + 1)).alias(_of(k)) for k in kinds]
        return saved(things.groupBy("pattern").agg(*worth, *counted), "patterns")

    none = unknown.select("pattern", F.lit(None).cast("int").alias("kind"), *(F.lit(0.0).alias(_of(k)) for k in kinds))
    scores = scored(seeds.unionByName(none))
    for _ in range(settings.rounds - 1):
        means = unknown.join(scores, "pattern").groupBy("thing").agg(*(F.avg(_of(k)).alias(_of(k)) for k in kinds))
        scores = scored(seeds.unionByName(unknown.join(means, "thing").withColumn("kind", F.lit(None).cast("int")).drop("thing")))
    return scores


def reliable(scores: DataFrame, settings: Settings) -> DataFrame:
    """``pattern``, ``kind`` and ``score`` of patterns that are reliable for a kind, the best one if for several."""

    def choice(k: int) -> Column:
        good = (F.col(_of(k)) >= settings.least) & (F.col(f"seeds_{KINDS[k]}") >= settings.support)
        return F.when(good, F.struct(F.col(_of(k)).alias("score"), F.lit(-k).alias("order")))

    best = F.greatest(*(choice(k) for k in range(len(KINDS))))
    return scores.select("pattern", best.alias("best")).where("best IS NOT NULL").select("pattern", (-F.col("best.order")).alias("kind"), "best.score")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Rows with their spans, and the reliable patterns.

    The rows have ``key``, ``n_<kind>``, ``base_sha256``, ``spans`` and ``n_found``, one for each row of ``docs``,
    also where keys repeat or are null. ``spans`` are kind:start:end by start and kind; spans that
    contexts found have kinds of their own (``like_<kind>``) and overlap no base span. A null text
    is empty. Other columns are not read, so their names do not matter.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    fields = "row long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string"
    find_type = "struct<start: int, end: int, kind: int, thing: long, patterns: array<string>>"
    kept = texts.select("row", "text", "key").mapInArrow(_keeping_key(_reading(settings)), f"key {texts.schema['key'].dataType.simpleString()}, {fields}, finds array<{find_type}>")
    read = saved(kept, "finds")
    finds = read.select("row", F.explode("finds").alias("find")).select("row", "find.*")
    places = finds.select("row", "start", "end", "kind", "thing", F.explode("patterns").alias("pattern"))
    edges = saved(places.select("pattern", "thing", "kind").distinct(), "edges")
    good = saved(reliable(pattern_scores(edges, settings), settings), "reliable")
    unknown = places.where("kind IS NULL").select("row", "start", "end", "pattern")
    best = F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")
    told = unknown.join(good, "pattern").groupBy("row", "start", "end").agg(best)
    added = told.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("kind") + len(KINDS)).alias("kind"), "end")).alias("added"))
    names = F.array(*map(F.lit, KINDS + FOUND))
    base = F.transform(F.filter("finds", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    spans = F.sort_array(F.concat(base, F.coalesce("added", none)))
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    rows = read.join(added, "row", "left").select(
        F.col("key").alias(key),
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.array_join(shown, ",").alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
    )
    return rows, good


def _keeping_key(read):
    """The key beside what ``read`` makes of a batch."""

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in read(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch.column("key"), *made.columns], ["key", *made.schema.names])

    return with_key
