"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits, feature after feature, shallow trees on the residuals of the logistic loss; their sum for a
feature is a lookup table over its bins, and for a pair of features a table over a coarse grid. A score is the
logistic of the sum of the looked-up values, added for whole batches.

Features are shares and counts of a whole text (see FEATURES); labels, language, source and id are none of them.
The model is fitted on at most SAMPLE labelled documents, those whose ids hash lowest; all rows are scored. A document
labelled both 0 and 1, or without an id, is not learned from; of rows of one id, the least text is. Null and empty
texts have all features 0 and get a score too; repeated rows are scored each, no rows give no rows. With no labels,
or one label only, the score is the constant share of label 1 (0.5 without labels). A column of docs that has the
score's name gives way to it; other columns stay as they are.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import add_columns, prepare

SAMPLE, BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 20_000, 32, 8, 150, 60, 8, 0.1
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "shout", "stop", "comma", "other_sign", "beyond_ascii", "space", "long_words", "short_words",
    "signed_words", "shouted_words", "capital_words", "new_words", "new_triples", "log_lines", "line_length", "new_lines", "letterless_words",
)


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = _bytes("0123456789")
_SYMBOL, _SHOUT, _STOP, _COMMA, _SPACE, _OTHER = _bytes("#*$%&|<>"), _bytes("!?"), _bytes("."), _bytes(",;:"), _bytes(" \t\r\x0b\x0c\n"), _bytes("()[]{}=+/\\@^~_-'\"`")
_BEYOND = np.arange(256) >= 128
_LETTER = _UPPER | _BEYOND | (np.arange(256) >= 97) & (np.arange(256) <= 122)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(K.mix(keys + doc.astype(np.uint64) * K.ODD), return_index=True)
    return np.bincount(doc[at], minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """One row for each text."""
    out = []
    for i, j, data, off in K.chunks(column):
        n = j - i
        w = K.words(data, off, K.SPACED)
        words = np.diff(w.off)
        size = np.diff(off)

        def share(flags, per, starts):
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[starts]) / np.maximum(per, 1)

        by_byte = lambda kind: share(kind[data], size, off)  # noqa: E731, B023
        by_word = lambda flags: share(flags, words, w.off)  # noqa: E731, B023
        length, last, first = w.stop - w.start, data[w.stop - 1], data[w.start]
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        has, big = letters[w.stop] - letters[w.start], upper[w.stop] - upper[w.start]
        triple = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        thirds = K.combine(w.hash[triple], w.hash[triple + 1], w.hash[triple + 2])
        text = data != 10
        ls, le = K.runs(text, off)
        ld = np.searchsorted(off, ls, "right") - 1
        lines = np.bincount(ld, minlength=n)
        out.append(np.stack([
            np.log1p(size), np.log1p(words), by_word(length), by_byte(_UPPER), by_byte(_DIGIT), by_byte(_SYMBOL), by_byte(_SHOUT), by_byte(_STOP), by_byte(_COMMA), by_byte(_OTHER), by_byte(_BEYOND), by_byte(_SPACE),
            by_word(length >= 12), by_word(length <= 3), by_word(_SYMBOL[last] | _SHOUT[last]), by_word((big == has) & (has > 1)), by_word(_UPPER[first]), _distinct(w.hash, w.doc, n) / np.maximum(words, 1),
            _distinct(thirds, w.doc[triple], n) / np.maximum(words - 2, 1), np.log1p(lines), size / np.maximum(lines, 1), _distinct(K.run_hashes(data, text, ls, le), ld, n) / np.maximum(lines, 1), by_word(has == 0),
        ], 1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Gam(NamedTuple):
    base: float
    edges: list[np.ndarray]  # of each feature's bins
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # bin to cell of the pairs' grids
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for j, k, t in self.pairs:
            total += t[self.coarse[j][bins[j]], self.coarse[k][bins[k]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree over one feature's ordered bins."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= _gain(g.sum(), h.sum()) + 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _corners(a: np.ndarray) -> np.ndarray:
    """Sums of the four quadrants around every cut of both axes."""
    c = np.cumsum(np.cumsum(a, 0), 1)
    low = c[:-1, :-1]
    left, top = c[:-1, -1:] - low, c[-1:, :-1] - low
    return np.stack([low, left, top, c[-1, -1] - low - left - top])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts each of the two features once."""
    cg, ch = _corners(g), _corners(h)
    gain = _gain(cg, ch).sum(0)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    value = _leaf(cg[:, a, b], ch[:, a, b])
    out = np.empty(g.shape)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = value
    return float(gain[a, b] - _gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    share = float(y.mean()) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(e) + 1) * COARSE // (len(e) + 1) for e in edges]
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    model = Gam(base, edges, tables, coarse, [])
    if share in (0.0, 1.0) or len(y) < 2:
        return model
    bins, total = model.bins(x), np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])), 2)
            tables[j] += step
            total += step[b]
    cells = [c[b] for c, b in zip(coarse, bins, strict=True)]

    def grid(j, k, v):
        return np.bincount(cells[j] * COARSE + cells[k], v, COARSE * COARSE).reshape(COARSE, COARSE)

    g, h = slopes()
    best = sorted(combinations([j for j in range(len(edges)) if len(edges[j])], 2), key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[0])[:PAIRS]
    pairs = [(j, k, np.zeros((COARSE, COARSE))) for j, k in best]
    for _ in range(PAIR_ROUNDS):
        for j, k, t in pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(j, k, g), grid(j, k, h))[1]
            t += step
            total += step[cells[j], cells[k]]
    return model._replace(pairs=pairs)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """docs (doc_id, text) to learn from; labels may have more ids and repeat them."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2 AND y IN (0, 1)").drop("y2")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", "y", *(f"f{j}" for j in range(x.shape[1]))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, y int, " + ", ".join(f"f{j} double" for j in range(len(FEATURES)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).mapInArrow(run, schema).toArrow().sort_by("doc_id")
    x = np.stack([rows[f"f{j}"].to_numpy() for j in range(len(FEATURES))], 1)
    return fit(x, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """docs with text and any other columns, plus the score under a name of its own."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    return add_columns(docs, [T.StructField(name, T.DoubleType())], lambda texts: [pa.array(shared.value.score(features(texts)))])
