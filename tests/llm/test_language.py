"""The sample of a language doesn't depend on what other languages there are; letters of all planes."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zastera.llm import langid


def test_rare_languages_keep_their_rows(spark, monkeypatch):
    got = Counter()

    def learn(rows, y, k):
        got.update(y.tolist())
        return np.zeros((langid.BUCKETS, k)), np.zeros(k)

    monkeypatch.setattr(langid, "learn", learn)
    lang = F.when(F.col("id") < 400, "a rare one").otherwise(F.concat(F.lit("big"), (F.col("id") % 9).cast("string")))
    langid.train(spark.range(36400, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), lang.alias("lang")))
    # Four rows in five are learned from.
    assert sum(got.values()) > 7000 and 280 <= got[0] <= 360 and all(700 <= got[k] <= 900 for k in range(1, 10))


def test_letters_of_all_planes(spark):
    texts = ["😀😀 🚀", "𐐀𐐁 𐐂", "𐐨𐐩 𐐪", "😀 abc 🚀", " abc "]
    got = {a + k: (bool(letter[k]), tuple(sorted(bucket[doc == k]))) for a, b, letter, doc, bucket in langid.ngrams(pa.array(texts)) for k in range(b - a)}
    assert [got[k][0] for k in range(5)] == [False, True, True, True, True] and got[1] == got[2]
    assert not got[0][1] and set(got[3][1]) == set(got[4][1])
    rows = [(k, "the house" if k % 2 else "das haus", "en" if k % 2 else "de") for k in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = langid.predict(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), model).first()
    assert (out["lang_pred"], out["score"]) == ("und", 1.0)
