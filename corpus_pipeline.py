"""Training-data pipeline: quality classifier, line dedup, near duplicates, benchmark decontamination, BPE.

Every stage takes (spark, docs, sf_dir); docs is a Parquet table with the columns of `documents`, all but the last
stage return those columns, and what a stage drops or changes is gone for the next.

Null texts count as empty everywhere; rows of equal or null ids are rows of their own; an empty table gives an empty
table; further columns travel along, whatever they are called, but for the last stage, which returns its digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zastera.llm import fsjoin, gam, linededup, posindex, triebpe
from zastera.llm.common import remainder, scratch, table, without_rows
from zastera.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.5 or more. Null and empty texts are scored as such; without labels all score 0.5 and stay."""
    name = "score"
    while name in docs.columns:
        name += "_"
    learn = lambda rows: rows.filter(remainder(F.col("doc_id"), 3) != 1)
    model = gam.train(learn(docs), learn(table(spark, sf_dir, "labels")))
    return gam.score(docs, model, name).filter(F.col(name) >= 0.5).drop(name).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; a document that loses every line goes, one that had none stays. n_chars follows the text."""
    rows = linededup.dedup_lines(docs).filter("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"doc.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null first, then the earliest row), of each group that links of similarity 0.8 or more on five-word shingles join. Documents without words are linked with nothing and stay."""
    found = scratch(fsjoin.near_duplicates(docs, share=80, words=5).select("root", "row", "doc_id"), "found")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first.row")
    later = found.join(first.select("root"), "root", "left_semi").join(first.select("row"), "row", "left_anti")
    return without_rows(docs, later)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; those without words never are. An empty benchmark leaves all."""
    return without_rows(docs, posindex.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, and hashes of the ids and of the text decoded from them; one row for each document."""
    return triebpe.digest(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The classifier and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
