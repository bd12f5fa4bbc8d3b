"""Quality rules by the log-likelihood ratio of hashed n-grams, with DataFrame functions only.

Two multinomials over BUCKETS hashed unigrams and bigrams are counted: one over the trusted target (documents that
`labels` marks as good), one over the whole corpus. A document's ratio is the mean over its n-grams of
ln(target share / corpus share), each with one added to every bucket. It is kept if the base rules hold and the
ratio is at least THRESHOLD; nothing is sampled or drawn.

The BUCKETS counts are all that reaches the driver. Good ids are broadcast up to MOST_IDS and joined by shuffle
beyond. Null and empty texts have no words, fail the base rules and have the ratio 0. A document that is labelled
both ways is not trusted. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, THRESHOLD, MOST_IDS = 1 << 16, -0.15, 4_000_000
GAP = r"[ \t-\r]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _pair(h: Column, i: Column, x: Column) -> Column:
    return F.pmod(F.xxhash64(F.get(h, i - 1), x), F.lit(BUCKETS)).cast("int")


def _one(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def good_ids(labels: DataFrame) -> DataFrame:
    """Documents with quality 1 and no other quality."""
    return labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = 1 AND high = 1").select("doc_id")


def weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """ln(target share / corpus share) of each bucket."""
    good = good_ids(labels).withColumn("good", F.lit(1))
    good = F.broadcast(good) if labels.count() <= MOST_IDS else good
    rows = docs.select("doc_id", "text").join(good, "doc_id", "left").select(F.coalesce("good", F.lit(0)).alias("good"), hashes(words(F.col("text"))).alias("h"))
    each = rows.select("good", F.explode(F.concat(F.transform("h", _one), F.slice(F.transform("h", lambda x, i: _pair(F.col("h"), i, x)), 2, F.greatest(F.size("h") - 1, F.lit(0))))).alias("bucket"))
    raw, target = [1.0] * BUCKETS, [1.0] * BUCKETS
    for r in each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("t")).collect():
        raw[r["bucket"]] += r["n"]
        target[r["bucket"]] += r["t"]
    all_raw, all_target = sum(raw), sum(target)
    return [math.log(t / all_target * all_raw / r) for t, r in zip(target, raw, strict=True)]


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, h (hashes of the words) and the base columns."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w")).select("*", hashes(F.col("w")).alias("h"))
    n = F.size("h")
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("h", i - 1), F.get("h", i), F.get("h", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    rows = rows.select("doc_id", "h", F.length(F.array_join("w", "")).alias("chars"), (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"), triples.alias("t"))
    sorted_ = F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda s, i, j: F.get(s, i)["x"] == F.get(s, j)["x"]
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("t")) < F.size("t"), sorted_).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    twice = F.filter("s", lambda x, k: F.coalesce(same(F.col("s"), k, k - 1), F.lit(False)) | F.coalesce(same(F.col("s"), k, k + 1), F.lit(False)))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "h", *(c.cast("long").alias(k) for k, c in (("n_words", F.size("h")), ("word_chars", F.col("chars")), ("n_symbols", F.col("symbols")), ("n_dup_lines", F.col("dup")), ("n_repeat_words", covered))))


def judge(docs: DataFrame, weight: list[float], threshold: float = THRESHOLD) -> DataFrame:
    table = F.split(F.lit(",".join(f"{x:.5g}" for x in weight)), ",").cast("array<float>")
    rows = base_rules(docs)
    total = F.aggregate(F.transform("h", lambda x, i: F.get(table, _one(x)) + F.when(i > 0, F.get(table, _pair(F.col("h"), i, x))).otherwise(F.lit(0.0).cast("float"))), F.lit(0.0), lambda a, x: a + x)
    ratio = F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), ratio.alias("ratio"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"), "ratio")
