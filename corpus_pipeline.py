"""From documents to packed training sequences: quality, near duplicates, repeated passages, packing.

``STAGES`` are applied in their order, each to all that the one before kept, written as Parquet
and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm import packing, quality, queries, repeats, shingle_join
from logsluice.llm.scale import saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; null texts are scored as empty."""
    # No name of the caller's is longer than this one.
    score = "score" + "_" * max(map(len, docs.columns))
    scored = quality.score(docs, queries.quality_model(spark, sf_dir), into=score)
    return scored.where(F.col(score) >= queries.GOOD).drop(score)


#: The general rule for near copies; the figures of ``op2_ngram_jaccard_join`` (3 and 90) hold for that query alone.
NEAR_COPIES = shingle_join.Settings(words=5, percent=80)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest ``doc_id``."""
    return shingle_join.one_of_each(docs, NEAR_COPIES)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start more than once; ``n_chars`` follows the text."""
    cut = repeats.dedup(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can train the classifier or tokenize; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
