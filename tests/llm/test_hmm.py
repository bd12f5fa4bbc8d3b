"""The hidden Markov model against sums over all state paths and plain recursions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zastera.llm import hmm

TEXTS = ["a b a c", "b c", None, "", "a a a b c a b", "a b a c", "c b a " * 30]


def share(x):
    return x / x.sum(-1, keepdims=True)


def some_model(rng, symbols):
    return hmm.Model(np.zeros(0, np.uint64), np.zeros(0), 0, 0, share(rng.random(hmm.STATES)), share(rng.random((hmm.STATES, hmm.STATES))), share(rng.random((hmm.STATES, symbols))).T.copy())


def all_paths(sym, m, states):
    """Likelihood and expected counts by adding up every path."""
    got = {"start": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((len(m.emit), states))}
    total = 0.0
    for path in itertools.product(range(states), repeat=len(sym)):
        p = m.start[path[0]] * m.emit[sym[0], path[0]]
        for t in range(1, len(sym)):
            p *= m.move[path[t - 1], path[t]] * m.emit[sym[t], path[t]]
        total += p
        got["start"][path[0]] += p
        for t, k in enumerate(path):
            got["emit"][sym[t], k] += p
            if t:
                got["move"][path[t - 1], k] += p
    return total, {k: x / total for k, x in got.items()}


@pytest.mark.parametrize("piece, step", [(4096, 1 << 18), (2, 3), (1, 1)])
def test_expected_counts_are_those_of_all_paths(monkeypatch, piece, step):
    monkeypatch.setattr(hmm, "STATES", 3)
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "STEP", step)
    rng = np.random.default_rng(5)
    m = some_model(rng, 4)
    texts = [rng.integers(0, 4, n) for n in (1, 6, 2, 5, 1, 4)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    into = hmm._empty(m)
    hmm.expected(np.concatenate(texts), off, m, into)
    want = [all_paths(x, m, 3) for x in texts]
    assert abs(into["log"] - sum(math.log(p) for p, _ in want)) < 1e-9
    for k in ("start", "move", "emit"):
        assert np.abs(into[k] - sum(w[k] for _, w in want)).max() < 1e-9
    assert np.abs(hmm.log_likelihood(np.concatenate(texts), off, m) - [math.log(p) for p, _ in want]).max() < 1e-9


def test_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    m = some_model(rng, 300)
    sym, off = rng.integers(0, 300, 3000), np.array([0, 700, 700 + 1, 3000])
    whole = hmm._empty(m)
    hmm.expected(sym, off, m, whole)
    logs = hmm.log_likelihood(sym, off, m)
    monkeypatch.setattr(hmm, "PIECE", 97)
    cut = hmm._empty(m)
    hmm.expected(sym, off, m, cut)
    assert all(np.abs(whole[k] - cut[k]).max() < 1e-7 for k in ("start", "move", "emit")) and abs(whole["log"] - cut["log"]) < 1e-7
    assert np.abs(hmm.log_likelihood(sym, off, m) - logs).max() < 1e-7 and abs(logs.sum() - whole["log"]) < 1e-7


def forward(tokens, m, symbol):
    a, log = None, 0.0
    for x in tokens:
        a = (m.start if a is None else a @ m.move) * m.emit[symbol(x)]
        log += math.log10(a.sum())
        a = a / a.sum()
    return log


@pytest.mark.parametrize("symbols", [65_536, 2])
def test_score_is_the_plain_recursion(spark, monkeypatch, symbols):
    """With few symbols, other words are emitted by class and drawn from it by count."""
    monkeypatch.setattr(hmm, "SYMBOLS", symbols)
    monkeypatch.setattr(hmm, "TOP", 3)
    docs = spark.createDataFrame([(k, t, k % 5 == 4) for k, t in enumerate(TEXTS)] + [(99, "zz A q", True), (None, "b", False)], "doc_id long, text string, held_out boolean").withColumn("row", F.lit("clash")).withColumn("h", F.lit(0))
    rows = [(r["doc_id"], r["text"], r["held_out"]) for r in docs.collect()]
    m, counts = hmm.train(docs.filter("NOT held_out"))
    split = lambda t: [*(t or "").lower().split(), None]
    n: dict = {}
    for _, t, held in rows:
        for x in [] if held else split(t):
            n[x] = n.get(x, 0) + 1
    total, v = sum(n.values()), len(n)
    import pyarrow as pa

    hashed = {x: next(hmm._tokens(pa.array([x or ""]))) for x in {*n, "zz", "q"}}
    of = {x: (h[0], int(kind[0])) for x, (_, _, h, kind, _) in hashed.items()}
    place = {int(h): k for k, h in enumerate(m.hashes[: m.symbols])}
    classes: dict = {}
    for x, c in n.items():
        if int(of[x][0]) not in place:
            classes.setdefault(of[x][1], []).append(c)
    symbol = lambda x: place.get(int(of[x][0]), m.symbols + max(of[x][1], 0))

    def within(x):
        if int(of[x][0]) in place:
            return 0.0
        own = classes.get(of[x][1], [])
        return math.log10((n.get(x, 0) + 0.5) / (sum(own) + 0.5 * (len(own) + 1)))

    got = {(r["doc_id"]): r for r in hmm.score(docs, m, counts).collect()}
    assert len(got) == len(rows)
    for k, t, held in rows:
        r, tokens = got[k], split(t)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held, len(tokens), total, sum(x in n for x in tokens))
        assert abs(r["base_score"] - sum(math.log10((n.get(x, 0) + 0.5) / (total + 0.5 * (v + 1))) for x in tokens)) < 1e-6
        assert abs(r["score"] - forward(tokens, m, symbol) - sum(map(within, tokens))) < 1e-6


def test_a_round_is_the_plain_one(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    before, _ = hmm.train(docs, 0)
    after, _ = hmm.train(docs, 1)
    read, into = hmm.Reader(before.hashes, before.symbols), hmm._empty(before)
    import pyarrow as pa

    for _, _, h, kind, off in hmm._tokens(pa.array(TEXTS)):
        hmm.expected(read(h, kind)[1], off, before, into)
    base = np.concatenate([before.counts[: before.symbols], np.zeros(hmm.CLASSES)]) + 0.5
    want = hmm.maximised(before, into, base / base.sum())
    for x, y in zip(want[4:], after[4:], strict=True):
        assert np.abs(x - y).max() < 1e-6


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    m, counts = hmm.train(none)
    assert hmm.score(none, m, counts).collect() == []
    r = hmm.score(spark.createDataFrame([(1, "a b", False)], none.schema), m, counts).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and np.isfinite(r["score"]) and r["base_score"] == 0
