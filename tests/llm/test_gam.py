"""Quality features and scores against plain versions; odd rows; held-out accuracy."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zastera.llm import gam

TEXTS = ["The cat sat. THE CAT!", None, "", "a\nb\na\n\nb b", "#$% 12,5 (x) é ÉA", "w " * 3000, " \t\n", "ab cd ab cd ab cd ab cd", "x", "ÿ\r\nend"]


def plain(text):
    """FEATURES of one text, by the byte."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lines = [x for x in b.split(b"\n") if x]
    size, n, m = len(b), len(words), len(lines)
    share = lambda chars, x=b: sum(c in chars for c in x) / max(size, 1)
    of = lambda test: sum(map(test, words)) / max(n, 1)
    upper = bytes(range(65, 91))
    letters = lambda w: sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w)
    big = lambda w: sum(c in upper for c in w)
    return [
        math.log1p(size), math.log1p(n), of(len), share(upper), share(b"0123456789"), share(b"#*$%&|<>"), share(b"!?"), share(b"."), share(b",;:"), share(b"()[]{}=+/\\@^~_-'\"`"),
        sum(c >= 128 for c in b) / max(size, 1), share(b" \t\r\x0b\x0c\n"), of(lambda w: len(w) >= 12), of(lambda w: len(w) <= 3), of(lambda w: w[-1] in b"#*$%&|<>!?"), of(lambda w: big(w) == letters(w) > 1),
        of(lambda w: w[0] in upper), len(set(words)) / max(n, 1), len({tuple(words[i : i + 3]) for i in range(n - 2)}) / max(n - 2, 1), math.log1p(m), size / max(m, 1), len(set(lines)) / max(m, 1), of(lambda w: letters(w) == 0),
    ]


def test_features_are_the_plain_ones():
    got = gam.features(pa.array(TEXTS))
    assert got.shape == (len(TEXTS), len(gam.FEATURES)) and np.abs(got - np.array([plain(t) for t in TEXTS])).max() < 1e-9


def test_score_adds_looked_up_values(spark):
    rng = np.random.default_rng(3)
    x = np.array([plain(t) for t in TEXTS * 30]) + rng.normal(0, 0.1, (30 * len(TEXTS), len(gam.FEATURES)))
    m = gam.fit(x, (rng.random(len(x)) < 0.5).astype(float))
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, "q")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = gam.score(docs, m).collect()
    assert len(got) == len(TEXTS) + 2 and got[0].asDict().keys() == {"doc_id", "text", "score", "a.b"}
    for r in got:
        f = plain(r["text"])
        bins = [sum(e <= v for e in edges) for edges, v in zip(m.edges, f, strict=True)]
        z = m.base + sum(t[b] for t, b in zip(m.tables, bins, strict=True)) + sum(t[m.coarse[j][bins[j]], m.coarse[k][bins[k]]] for j, k, t in m.pairs)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def brute_tree(g, h, depth):
    leaf = lambda a: sum(g[i] for i in a) / (sum(h[i] for i in a) + 1)
    gain = lambda a: sum(g[i] for i in a) ** 2 / (sum(h[i] for i in a) + 1)

    def grow(a, d):
        cuts = [(gain(a[:c]) + gain(a[c:]), -c) for c in range(1, len(a))] if d else []
        best = max(cuts, default=(0, 0))
        if not cuts or best[0] <= gain(a) + 1e-9:
            return [leaf(a)] * len(a)
        return grow(a[: -best[1]], d - 1) + grow(a[-best[1] :], d - 1)

    return grow(list(range(len(g))), depth)


@pytest.mark.parametrize("seed", range(5))
def test_trees_take_the_best_cuts(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(0, 3, 9), rng.random(9) * 5
    assert np.abs(gam._tree(g, h, 2) - brute_tree(g, h, 2)).max() < 1e-9
    g, h = rng.normal(0, 3, (4, 5)), rng.random((4, 5)) * 5
    gain, value = gam._quadrants(g, h)
    best = max(sum(q.sum() ** 2 / (w.sum() + 1) for q, w in ((g[:a, :b], h[:a, :b]), (g[:a, b:], h[:a, b:]), (g[a:, :b], h[a:, :b]), (g[a:, b:], h[a:, b:]))) for a in range(1, 4) for b in range(1, 5))
    assert abs(gain - (best - g.sum() ** 2 / (h.sum() + 1))) < 1e-9 and value.shape == (4, 5)


def test_training_on_labels(spark):
    good, bad = "The quick fox ran home, and it slept well. ", "BUY $$$ NOW!!! ### "
    rows = [(k, (good if k % 2 else bad) * (1 + k % 7) + str(k)) for k in range(200)]
    docs = spark.createDataFrame(rows + [(1, good), (None, bad), (7, None)], "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(3, 1), (4, 1), (None, 1), (5, None), (999, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    m = gam.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in gam.score(docs.filter("doc_id >= 100"), m).collect()}
    assert all((x >= 0.5) == bool(k % 2) for k, x in got.items()) and len(got) == 100
    one = gam.train(docs, labels.filter("quality = 1 AND doc_id < 100 AND doc_id <> 4"))
    assert all(r["score"] == pytest.approx(1, abs=1e-5) for r in gam.score(docs, one).collect())


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    none = gam.train(docs.limit(0), labels)
    assert [r["score"] for r in gam.score(docs, none).collect()] == [0.5] and gam.score(docs.limit(0), none).collect() == []
