"""One query per operator of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm import chat, fingerprint, kneser_ney, licences, merkle, packing, pieces, pii, quality, repeats, shingle_join, spelling, voronoi

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation whose texts look like the template.
LOOKALIKE = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(LOOKALIKE).alias("text"),
    )
    return chat.read_back(chat.format_conversations(given.unionByName(extra)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


#: Scores from which a document counts as good.
GOOD = 0.7


def _remainder(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Learned from labelled documents that are not held out."""
    labels, docs = (_table(spark, sf_dir, name) for name in ("labels", "documents"))
    return quality.train(docs, labels, usable=_remainder("labelled_id", 4) != 2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, sf_dir)).select(
        "doc_id",
        F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder("doc_id", 10) == 0, F.lit(False))
    scored = kneser_ney.score(docs, kneser_ney.train(docs.where(~held_out)))
    return scored.withColumn("held_out", held_out)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return voronoi.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, repeats.find_repeats(docs), kept_as=None).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    fields = [F.col(c) for c in docs.columns]
    claimed = F.when(_remainder("doc_id", 7) == 0, merkle.leaf(*fields[:3], more, fields[4]))
    rows = merkle.manifest(docs, "lang", "doc_id", merkle.leaf(*fields), claimed).rows
    folded = rows.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return folded.select(
        "row.doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.node(merkle.siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the texts, one run in 199 with a character left out, as its own hash tells."""
    runs = spelling.runs(_table(spark, sf_dir, "documents"), "doc_id")
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.withColumn("h", F.crc32(named.cast("binary")))
    damaged = spelling.without_character(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    return spelling.variants(hashed.select(F.when(F.col("h") % 199 == 0, damaged).otherwise(F.col("run")).alias("word")))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))[0]


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_license_scans": op6_license_scans,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_pii": op13_pii,
}
