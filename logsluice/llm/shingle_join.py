"""Jaccard links between documents by prefix filters under several global token orders.

A document's tokens are its distinct word shingles. All of them are counted, so that every order
can start with the rare ones; a token of one document alone takes a place in a prefix but can
join nothing, so it is never sent. A pair can only link if the two share a token of their
prefixes in every order. The first order finds the pairs, with what the positions of the tokens
still allow; the other orders must agree before the sets are compared.

Documents with equal sets are one class. Within the rows of a token, classes are first compared
with the most central one of about their size; what this links is one component. Then every pair
of a token's rows that lies in two components is compared, so no link between components is lost,
and a large group of near copies costs about one comparison a document and not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.components import components
from logsluice.llm.counted import SLICE, counting, dealt, hash_shard, sums_by_shard
from logsluice.llm.scale import parts, quoted, saved, shared_folder
from logsluice.llm.shared_arrays import SharedArrays
from logsluice.llm.words import mix, ngrams, row_groups, split_words, text_bytes

SHARD_BYTES = 8 << 20
#: What tells rows apart whose ids repeat: the id and two hashes of the text.
KEY = "struct<doc_id: bigint, one: bigint, two: bigint>"
#: Orders beside the first.
MORE_ORDERS = 2


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; documents link from ``percent`` per cent of the union on."""

    words: int = 3
    percent: int = 90


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; a text of fewer words is one shingle, one without words has none."""
    words = split_words(data, offsets)
    hashed, at = ngrams(words, n)
    cuts = np.searchsorted(at, words.first)
    found = []
    for row in range(len(offsets) - 1):
        first, size = int(words.first[row]), int(words.first[row + 1] - words.first[row])
        if 0 < size < n:
            whole = np.uint64(size)
            for word in words.hashes[first : first + size]:
                whole = mix(np.array([whole * np.uint64(3) + word]))[0]
            found.append(np.array([whole]))
        else:
            found.append(np.unique(hashed[cuts[row] : cuts[row + 1]]))
    return found


@dataclass(frozen=True)
class Shared:
    """Tokens of two documents or more: their numbers go by shard and hash."""

    folder: str
    bases: tuple[int, ...]


@lru_cache(maxsize=2)
def _arrays(shared: Shared) -> list[tuple[np.ndarray, np.ndarray]]:
    store = SharedArrays(shared.folder)
    sizes = np.diff(shared.bases)
    return [(store.read(f"tokens-{k}", np.uint64), store.read(f"documents-{k}", np.uint32)) if n else None for k, n in enumerate(sizes)]


def _numbered(tokens: np.ndarray, shared: Shared) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and document counts of the shared ones of sorted tokens."""
    numbers, counts = [], []
    shards = hash_shard(tokens, len(shared.bases) - 1)
    held = _arrays(shared)
    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(tokens)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b or held[shards[a]] is None:
            continue
        known, documents = held[shards[a]]
        place = np.searchsorted(known, tokens[a:b])
        place[place == len(known)] = 0
        place = place[known[place] == tokens[a:b]]
        numbers.append(shared.bases[shards[a]] + place)
        counts.append(documents[place])
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(numbers), np.concatenate(counts)


def count_tokens(docs: DataFrame, settings: Settings) -> Shared:
    """Count in how many rows each shingle is; arrays of the shared ones go to the shared folder."""
    shards = parts(docs, SHARD_BYTES)
    folder = shared_folder(docs.sparkSession, "shingles")
    arrays = SharedArrays(folder)

    def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *shingles(data, offsets, settings.words)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, tokens, counts in sums_by_shard(batches):
            kept = counts > 1
            arrays.write(f"tokens-{shard}", tokens[kept])
            arrays.write(f"documents-{shard}", np.minimum(counts[kept], (1 << 32) - 1).astype(np.uint32))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [int(kept.sum())]})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(counting(keys, lambda h: hash_shard(h, shards)), SLICE)
    found = {r["shard"]: r["n"] for r in dealt(counted, shards).mapInArrow(write, "shard long, n long").collect()}
    return Shared(folder, tuple(np.cumsum([0, *(found.get(k, 0) for k in range(shards))]).tolist()))


def _least_shared(size: int, percent: int) -> int:
    """Tokens that a set of this size shares with any set it links with."""
    return -(-percent * size // 100)


def _members(docs: DataFrame, settings: Settings, shared: Shared, key: str) -> DataFrame:
    """Per row: ``doc_id``, ``n``, ``set`` (128 bits that stand for the whole set), and for rows that may
    link with another set their shared ``tokens``, the prefix of each order, and ``unique``, how many
    tokens stand before the shared ones."""
    number = "int" if shared.bases[-1] < 1 << 31 else "long"
    kind = np.int32 if number == "int" else np.int64
    names = ["tokens", *(f"prefix{k}" for k in range(MORE_ORDERS + 1))]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                rows = [_described(t, settings, shared) for t in shingles(data, offsets[lo : hi + 1], settings.words)]
                columns = {"doc_id": batch.column(0).slice(lo, hi - lo)}
                columns["n"] = pa.array([r[0] for r in rows], pa.int64())
                columns["set"] = pa.array([r[1] for r in rows], pa.binary())
                columns["unique"] = pa.array([r[2] for r in rows], pa.int64())
                lists = pa.list_(pa.from_numpy_dtype(kind))
                for k, name in enumerate(names):
                    columns[name] = pa.array([None if r[3] is None else r[3][k].astype(kind) for r in rows], lists)
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {key}, n long, set binary, unique long, " + ", ".join(f"{x} array<{number}>" for x in names)
    return docs.select(F.col("doc_id").cast(key), F.col("text").cast("string")).mapInArrow(describe, schema)


def _described(tokens: np.ndarray, settings: Settings, shared: Shared) -> tuple:
    n = len(tokens)
    if not n:
        return 0, None, 0, None
    name = b"".join(int(np.bitwise_xor.reduce(mix(tokens * np.uint64(2 * k + 3)))).to_bytes(8) for k in range(2))
    numbers, counts = _numbered(tokens, shared)
    unique = n - len(numbers)
    room = n - _least_shared(n, settings.percent) + 1 - unique
    if room <= 0:
        return n, name, unique, None
    prefixes = []
    for k in range(MORE_ORDERS + 1):
        rarity = counts if k == 0 else np.log2(counts).astype(np.int64)
        order = np.lexsort((mix(numbers.astype(np.uint64) * np.uint64(MORE_ORDERS + 1) + np.uint64(k)), rarity))
        prefixes.append(numbers[order[:room]])
    return n, name, unique, [numbers, *prefixes]


def _may_link(percent: int) -> Column:
    """What sizes and positions of a common token in the first order allow, before which nothing is shared."""
    most = F.least(F.col("u.n") - F.col("u.at"), F.col("v.n") - F.col("v.at"))
    return (100 + percent) * most >= percent * (F.col("u.n") + F.col("v.n"))


def _size_band(percent: int) -> Column:
    """Bands so wide that sets that link lie in one or in neighbouring ones; with equal sets only, each size is one."""
    if percent >= 100:
        return F.col("n").cast("long")
    # The width is a little more than the ratio of sizes, which makes up for rounding.
    return F.floor(F.log("n") / F.log(F.lit(100 / max(percent, 1) + 1e-6)))


def _near_bands() -> Column:
    return F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)


def _with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of a token that may link with another one by what is known of whole bands: the smallest set, and the
    most that stands behind the token in one. A family whose sets have the token too far behind forms no pairs."""
    behind = F.col("n") - F.col("at")
    bands = rows.groupBy("token", "band").agg(F.min("n").alias("least"), F.max(behind).alias("most"))
    reach = bands.select("token", F.explode(_near_bands()).alias("band"), "least", "most")
    # Of three bands the best of both figures: no row is left out that one of them allows.
    reach = reach.groupBy("token", "band").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    able = (100 + percent) * F.least(behind, F.col("most")) >= percent * (F.col("n") + F.col("least"))
    return rows.join(reach, ["token", "band"]).where(able).drop("least", "most")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that link: prefixes of all other orders meet, then the sets are compared."""
    of = lambda name: classes.select(F.col("set").alias(name), F.struct("n", "tokens", *(f"prefix{k}" for k in range(1, MORE_ORDERS + 1))).alias(f"{name}_"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    filters = [F.arrays_overlap(F.col(f"a_.prefix{k}"), F.col(f"b_.prefix{k}")) for k in range(1, MORE_ORDERS + 1)]
    shared = F.size(F.array_intersect(F.col("a_.tokens"), F.col("b_.tokens")))
    linked = (100 + percent) * shared >= percent * (F.col("a_.n") + F.col("b_.n"))
    return both.where(reduce(Column.__and__, filters)).where(linked).select("a", "b")


def links(docs: DataFrame, settings: Settings = Settings(), key: str = "long") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Rows (``doc_id`` as ``key``, ``n``, ``set``) and the components (``set``, ``component``) of sets that link with others.

    Two sets link when 100 * intersection >= percent * union. Null texts and texts without words
    have a null ``set``. Sets are compared by 64-bit hashes of their shingles.
    """
    shared = count_tokens(docs, settings)
    members = saved(_members(docs, settings, shared, key), "members")
    classes = members.where("tokens IS NOT NULL").groupBy("set")
    columns = ["n", "unique", "tokens", *(f"prefix{k}" for k in range(MORE_ORDERS + 1))]
    classes = saved(classes.agg(*(F.first(c).alias(c) for c in columns)), "classes")
    rows = classes.select("set", "n", "unique", F.posexplode("prefix0").alias("place", "token"))
    rows = rows.select("set", "n", "token", (F.col("unique") + F.col("place")).alias("at"))
    band = F.floor(F.log("n") / F.log(F.lit(2 - settings.percent / 100))).alias("band")
    counted = rows.groupBy("token").agg(F.count("*").alias("together")).where("together > 1").select("token")
    rows = saved(rows.join(counted, "token").withColumn("band", band), "prefixes")

    hubs = rows.groupBy("token", "band").agg(F.min(F.struct("at", "set", "n")).alias("u"))
    near = rows.alias("v").join(hubs.alias("h"), ["token", "band"])
    near = near.select("u", F.struct(F.col("v.set").alias("set"), F.col("v.n").alias("n"), F.col("v.at").alias("at")).alias("v"))
    near = near.where(F.col("u.set") != F.col("v.set")).where(_may_link(settings.percent))
    first = saved(_verified(_pairs(near), classes, settings.percent), "links")
    known = components(first)

    labelled = rows.join(known.withColumnRenamed("node", "set"), "set", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "set"))
    apart = labelled.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    apart = saved(labelled.join(apart.where("least <> most").select("token"), "token"), "apart")
    # Sets that link have sizes in one band of this width or in neighbouring ones.
    apart = _with_partners(apart.withColumn("band", _size_band(settings.percent)), settings.percent)
    side = lambda name, band: apart.select("token", band.alias("band"), F.struct("set", "n", "at", "component").alias(name))
    allowed = (F.col("u.component") < F.col("v.component")) & _may_link(settings.percent)
    cross = side("u", F.col("band")).join(side("v", F.explode(_near_bands())), ["token", "band"]).where(allowed)
    more = saved(_verified(_pairs(cross.select("u", "v")), classes, settings.percent), "links")
    joined = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    return members.select("doc_id", "n", "set"), components(joined).withColumnRenamed("node", "set")


def _pairs(rows: DataFrame) -> DataFrame:
    a, b = F.least("u.set", "v.set").alias("a"), F.greatest("u.set", "v.set").alias("b")
    return rows.select(a, b).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included; null
    ids count only where there is no other. Rows with equal sets link, unless they are empty.
    """
    members, found = links(docs, settings)
    smallest = members.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    smallest = smallest.join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
    reach = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = smallest.select("set", "component").join(reach, "component").select("set", "component_id")
    return members.join(of_set, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with one row of each component, that of the smallest ``doc_id`` (null last, then by the text's hash).

    Texts without words link with nothing, and all their rows stay. Rows are told apart by id and
    text: other texts of an id stay unless they link with something. Of rows that have both in common, which
    are copies, one stays.
    """
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))
    members, found = links(docs.select(key.alias("doc_id"), "text"), settings, KEY)
    placed = members.where("set IS NOT NULL").join(found, "set", "left").select("doc_id", F.coalesce("component", "set").alias("component"))
    counted = placed.groupBy("component", "doc_id").agg(F.count("*").alias("times"))
    first = F.min_by(F.struct("doc_id", "times"), F.struct(F.col("doc_id.doc_id").isNull(), "doc_id")).alias("first")
    chosen = counted.groupBy("component").agg(first).select(F.col("first.doc_id").alias("key"), "first.times")
    # The caller's columns travel in one, so that no name of theirs can meet one of these.
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), key.alias("key"))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    stay = packed.join(chosen, "key")
    others = [F.col("row").getField(c) for c in docs.columns if c.lower() != "text"]
    order = F.xxhash64(F.to_json(F.struct(*(o.alias(f"c{k}") for k, o in enumerate(others)))))
    copies = stay.where("times > 1").groupBy("key").agg(F.min_by("row", order).alias("row"))
    rows = stay.where("times = 1").select("row").unionByName(copies.select("row"))
    rows = rows.unionByName(packed.where(~F.coalesce(worded, F.lit(False))).select("row"))
    return rows.select("row.*")
