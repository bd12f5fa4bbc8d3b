"""Decontamination against a plain search, with one block and with several, and on odd rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zastera.llm import posindex

RNG = np.random.default_rng(11)


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def draw(n, of=9):
    return [f"w{k}" for k in RNG.integers(0, of, n)]


LONG = [f"L{k}" for k in range(40)]
ITEMS = [(1, " ".join(LONG[:25])), (1, " ".join(LONG[:25])), (2, "W1 w2, w3"), (3, "w4"), (4, None), (5, " .. "), (None, " ".join(LONG[20:34])), (6, " ".join(draw(16))), (7, "w1 w2 w3 w4 w5"), (8, " ".join(LONG[:25]))]


def changed(words, *at):
    return [f"z{k}" if k in at else w for k, w in enumerate(words)]


TEXTS = [(1, " ".join(["x", *LONG, "y"])), (2, " ".join(changed(LONG, 6, 17))), (3, None), (4, ""), (5, " ".join(draw(300))), (5, " ".join(draw(300))), (None, "w4"), (6, " ".join([*LONG[:8], "new", *LONG[8:25]])), (7, " ".join(LONG[2:12])), (8, "?!"), (9, " ".join(draw(30, 4) * 40)), (10, " ".join(LONG[1:12][::-1]))]


def plain(texts, items):
    """(n_words, n_hit, items, near) of each text, by trying every window at every place."""
    docs = [split(t) for _, t in texts]
    often = {}
    for w in docs:
        for x in w:
            often[x] = often.get(x, 0) + 1
    windows = {}
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).update([] if k is None else [str(k)])
    out = []
    for w in docs:
        hit, own, near = set(), set(), set()
        for win, names in windows.items():
            n = len(win)
            need = math.ceil(posindex.NEAR * n - 1e-9)
            exact = [s for s in range(len(w) - n + 1) if tuple(w[s : s + n]) == win]
            hit.update(x for s in exact for x in range(s, s + n))
            own |= names if exact else set()
            anchors = sorted(range(n), key=lambda o: (often.get(win[o], 0), o))[: n - need + 1]
            at = lambda p: w[p] if 0 <= p < len(w) else None  # noqa: B023, E731
            starts = [s for s in range(-n, len(w)) if any(at(s + o) == win[o] for o in anchors) and sum(any(at(s + o + d) == win[o] for d in range(-2, 3)) for o in range(n)) >= need]
            starts = [s for s in starts if all(abs(s - e) > 2 for e in exact)]
            starts = [s for k, s in enumerate(starts) if k == 0 or s - starts[k - 1] > 2]
            near |= {(x, max(0, s), min(len(w), s + n)) for x in names for s in starts}
        out.append((len(w), len(hit), sorted(own), sorted(near)))
    return out


@pytest.mark.parametrize("block, terms, step", [(1 << 20, 1 << 20, 1 << 18), (60, 1 << 20, 3), (60, 0, 7)])
def test_index_search_equals_a_plain_one(spark, monkeypatch, block, terms, step):
    monkeypatch.setattr(posindex, "BLOCK", block)
    monkeypatch.setattr(posindex, "MOST_TERMS", terms)
    monkeypatch.setattr(posindex, "STEP", step)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n_hit", F.lit(0))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("w", F.lit("clash"))
    got = posindex.decontaminate(docs, bench).collect()
    want = plain(TEXTS, ITEMS)
    key = lambda x: (str(x[0]), x[1:])
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(x) for x in r["near"]]) for r in got]
    assert sorted(rows, key=key) == sorted(((k, *x) for (k, _), x in zip(TEXTS, want, strict=True)), key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    assert sum(len(x[3]) > 0 for x in want) >= 3 and any(x[2] for x in want)


def test_postings_are_stored_terms_and_places(spark):
    docs = spark.createDataFrame([(0, 1, "a b A"), (1, 2, None)], "row long, doc_id long, text string")
    got = {r["doc_id"]: r for r in posindex.index(docs).collect()}
    at = sorted(np.split(np.array(got[1]["places"]), np.cumsum(got[1]["n"])[:-1]), key=lambda x: x[0])
    assert [x.tolist() for x in at] == [[0, 2], [1]] and got[1]["n_words"] == 3 and got[2]["terms"] == []


def test_a_long_text_in_bounded_steps(spark):
    text = " ".join(f"a{k % 3} a{k % 5} a{k % 7}" for k in range(40_000))
    bench = spark.createDataFrame([(k, " ".join(f"a{(k * j) % 7}" for j in range(1, 20))) for k in range(30)], "item_id long, text string")
    got = posindex.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert got["n_words"] == 120_000


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(TEXTS[:2], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert posindex.decontaminate(docs.limit(0), bench).collect() == []
    assert [(r["n_hit"], r["contaminated"]) for r in posindex.decontaminate(docs, bench.limit(0)).collect()] == [(0, False)] * 2
