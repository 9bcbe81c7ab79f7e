"""Rows in the order of their ids, each followed by the next one, in range partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranges:
    """``groups``: the bounds of the ranges, in about as many groups as a group has bounds."""

    groups: list[list[int]]

    @staticmethod
    def of(docs: DataFrame, n: int) -> Ranges:
        """About ``n`` ranges with like numbers of ids; what comes to the driver are the bounds."""
        probabilities = [k / n for k in range(1, n)]
        bounds = sorted({round(x) for x in docs.stat.approxQuantile("doc_id", probabilities, 0.2 / n)}) if n > 1 else []
        width = max(1, int(len(bounds) ** 0.5))
        return Ranges([bounds[i : i + width] for i in range(0, len(bounds), width)])

    def __len__(self) -> int:
        return sum(map(len, self.groups)) + 1

    def number(self, key: Column) -> Column:
        """The range of an id: how many bounds do not lie above it; a null is in the first."""
        if not self.groups:
            return F.lit(0)
        bounds = lambda group: F.array(*(F.lit(b).cast("long") for b in group))
        reached = lambda array: F.size(F.filter(array, lambda b: b <= key))
        group = reached(bounds([g[0] for g in self.groups]))
        within = F.when(group > 0, reached(F.get(F.array(*map(bounds, self.groups)), group - 1))).otherwise(0)
        return F.greatest(group - 1, F.lit(0)) * len(self.groups[0]) + within


def with_successors(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) sorted so that each row's successor is the row after it.

    Partitions are sorted by (``range``, ``ahead``, ``doc_id``, hash of the text, text), nulls
    first. Rows with ``ahead`` are copies: the first row of the next range that has rows, behind
    the last row of a range; the last range is followed by the first. The first rows' ids come
    to the driver, one per range.
    """
    ranges = Ranges.of(docs, n)
    numbered = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), ranges.number(F.col("doc_id")).alias("range"))
    firsts = sorted(numbered.groupBy("range").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect())
    if not firsts:
        return numbered.withColumn("ahead", F.lit(False))
    before = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    first = {r["range"]: r["first"] for r in firsts}
    every = range(len(ranges))
    ids = F.array(*(F.lit(first[k]["doc_id"] if k in first else None).cast("long") for k in every))
    hashes = F.array(*(F.lit(first[k]["hash"] if k in first else None).cast("long") for k in every))
    previous = F.array(*(F.lit(before.get(k)).cast("int") for k in every))
    own = F.col("range")
    is_first = F.get(ids, own).eqNullSafe(F.col("doc_id")) & (F.get(hashes, own) == F.col("hash"))
    row = F.struct(own.alias("range"), F.lit(False).alias("ahead"))
    copy = F.struct(F.get(previous, own).alias("range"), F.lit(True).alias("ahead"))
    places = F.when(is_first, F.array(row, copy)).otherwise(F.array(row))
    dealt = numbered.select("doc_id", "text", "hash", F.explode(places).alias("place"))
    dealt = dealt.select("place.range", "place.ahead", "doc_id", "hash", "text").repartitionByRange(len(firsts), "range")
    return dealt.sortWithinPartitions("range", "ahead", "doc_id", "hash", "text")
