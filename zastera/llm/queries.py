"""The queries of this subpackage and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, fsjoin, gam, hmm, langid, linededup, posindex, ratio, triebpe, warc
from .common import prepare, remainder, table


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    model, counts = hmm.train(docs.filter("NOT held_out"))
    return hmm.score(docs, model, counts)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc")


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = gam.train(docs.filter("NOT held_out"), table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1))
    return gam.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = posindex.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triebpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ratio.judge(docs, ratio.weights(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_score": op1_hmm_score,
    "op2_line_dedup": op2_line_dedup,
    "op3_gam_quality": op3_gam_quality,
    "op5_language_id": op5_language_id,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_licence_scan": op7_licence_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_trie_bpe": op10_trie_bpe,
    "op4_ngram_ratio": op4_ngram_ratio,
}
ORACLES: dict[str, str] = {"op2_line_dedup": linededup.ORACLE, "op8_jaccard_join": fsjoin.ORACLE, "op9_decontaminate": posindex.ORACLE}
