"""Language ID: n-grams, frequencies, the learning steps and predictions against plain versions; odd rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zastera.llm import kernel as K
from zastera.llm import langid

TEXTS = ["The house, the garden", "das haus und 12 gärten", None, "", "12 !?", "a", "é" * 5000, "𐐀b c", "\t\n"]


def plain(text):
    """Buckets of the bigrams and trigrams of one text."""
    c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 32 for x in text or ""]
    out = []
    for n in (2, 3):
        for i in range(len(c) - n + 1):
            g = c[i : i + n]
            if not any(g[j] == g[j + 1] == 32 for j in range(n - 1)):
                out.append(sum(x << (21 * j) for j, x in enumerate(g)))
    return [int(K.mix(np.array([x], np.uint64) + K.ODD)[0] % np.uint64(langid.BUCKETS)) for x in out]


def test_ngrams_are_the_plain_ones():
    got = {a + k: (bool(letter[k]), Counter(bucket[doc == k].tolist())) for a, b, letter, doc, bucket in langid.ngrams(pa.array(TEXTS)) for k in range(b - a)}
    for k, t in enumerate(TEXTS):
        assert got[k] == (any(x.isalpha() for x in t or ""), Counter(plain(t)))


def test_document_frequencies(spark):
    df, n = langid.document_frequency(spark.createDataFrame([(t,) for t in TEXTS[:2]], "text string"))
    want = Counter(x for t in TEXTS[:2] for x in set(plain(t)))
    assert n == 2 and {k: int(df[k]) for k in np.flatnonzero(df)} == want


def test_steps_are_those_of_ftrl(monkeypatch):
    """Weight by weight, with Python numbers."""
    monkeypatch.setattr(langid, "BUCKETS", 5)
    monkeypatch.setattr(langid, "L1", 1.5)
    rng = np.random.default_rng(2)
    rows = [(np.append(np.sort(rng.choice(5, 3, replace=False)), 5), np.append(rng.random(3), 1.0)) for _ in range(12)]
    y = rng.integers(0, 3, 12)
    w, b = langid.learn(rows, y, 3)
    z = [[0.0] * 3 for _ in range(6)]
    n = [[0.0] * 3 for _ in range(6)]

    def weight(i, k):
        if abs(z[i][k]) <= langid.L1:
            return 0.0
        return -(z[i][k] - math.copysign(langid.L1, z[i][k])) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(langid.EPOCHS):
        for r in order.permutation(12):
            at, v = rows[r]
            now = {(i, k): weight(i, k) for i in at for k in range(3)}
            e = [math.exp(sum(x * now[i, k] for i, x in zip(at, v, strict=True))) for k in range(3)]
            for i, x in zip(at, v, strict=True):
                for k in range(3):
                    g = x * (e[k] / sum(e) - (k == y[r]))
                    s = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA
                    z[i][k] += g - s * now[i, k]
                    n[i][k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(6)])
    assert np.abs(np.vstack([w, b]) - want).max() < 1e-9 and (want == 0).any()


def test_prediction_is_the_plain_one(spark):
    rng = np.random.default_rng(8)
    m = langid.Language(["aa", "bb"], rng.random(langid.BUCKETS) + 1, rng.normal(0, 1, (langid.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.1]), 0.7)
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (None, "xy")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(3)).withColumn("x.y", F.lit(1))
    got = langid.predict(docs, m).collect()
    assert len(got) == len(TEXTS) + 2 and got[0].asDict().keys() == {"doc_id", "text", "x.y", "lang_pred", "score"}
    for r in got:
        t = r["text"] or ""
        if not any(x.isalpha() for x in t):
            assert (r["lang_pred"], r["score"]) == ("und", 1.0)
            continue
        v = {k: c * m.idf[k] for k, c in Counter(plain(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        logit = [(sum(x / size * float(m.weight[i, k]) for i, x in v.items()) + m.bias[k]) / m.temperature for k in range(2)]
        p = [math.exp(x) / sum(map(math.exp, logit)) for x in logit]
        assert r["lang_pred"] == m.names[p.index(max(p))] and abs(r["score"] - max(p)) < 1e-4


def test_held_out_texts_and_empty_tables(spark):
    rng = np.random.default_rng(9)
    words = {"en": "the house and garden of this with which".split(), "de": "das haus und der garten mit welche nicht".split(), "es": "la casa y el jardín con los que".split()}
    rows = [(k, " ".join(rng.choice(words[x], 12)), x) for k, x in enumerate(["en", "de", "es"] * 60)] + [(500, "??", "en"), (501, None, "en"), (502, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 3 <> 1 OR doc_id < 90"))
    got = langid.predict(docs.filter("doc_id BETWEEN 90 AND 200"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    assert langid.train(docs.limit(0)) is None and langid.predict(docs.limit(0), model).collect() == []
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs.filter("doc_id >= 500"), None).collect()} == {("und", 1.0), ("und", 0.0)}
