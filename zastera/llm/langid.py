"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are code points, lower-cased one by one; what is no letter is a space. Bigrams and trigrams are hashed
into BUCKETS. Document frequencies are counted over all training rows; the weights are learned on a sample of each
language (about PER_LANGUAGE rows, or all of fewer, by lowest hash of the row) with follow-the-regularised-leader and
an elastic net, and one row in five of the sample sets the temperature instead.

A null text, or one without a letter, is `und` with score 1. Without training rows every text is `und` with score
0. Repeated rows are predicted each; null languages are never learned; no rows give no rows. Columns of docs named
lang_pred or score give way to the prediction; other columns stay as they are. Texts are read whole.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import add_columns, prepare

BUCKETS, PER_LANGUAGE, TEXTS = 1 << 14, 1_000, 64
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
_POINTS = 0x110000


def _letters() -> np.ndarray:
    """Code point to lower-case letter, or a space."""
    out = np.full(_POINTS, 32, np.uint32)
    for c in range(_POINTS):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def ngrams(column: pa.Array):
    """For runs of at most TEXTS texts: first row, end row, whether each has a letter, text and bucket of each n-gram."""
    if not _TABLE:
        _TABLE.append(_letters())
    table = _TABLE[0]
    for i, j, data, off in K.chunks(column):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[off]
        c = table[points].astype(np.uint64)
        for a in range(i, j, TEXTS):
            b = min(j, a + TEXTS)
            lo, hi = at[a - i], at[b - i]
            part, cut = c[lo:hi], at[a - i : b - i + 1] - lo
            doc = np.repeat(np.arange(b - a), np.diff(cut))
            letter = np.bincount(doc[part != 32], minlength=b - a) > 0
            two = part[:-1] | part[1:] << np.uint64(21)
            keep2 = (doc[:-1] == doc[1:]) & (two != 32 + (32 << 21))
            three = two[:-1] | part[2:] << np.uint64(42)
            keep3 = keep2[:-1] & keep2[1:]
            codes = np.concatenate([two[keep2], three[keep3]])
            yield a, b, letter, np.concatenate([doc[:-1][keep2], doc[:-2][keep3]]), (K.mix(codes + K.ODD) % np.uint64(BUCKETS)).astype(np.int64)


class Language(NamedTuple):
    names: list[str]
    idf: np.ndarray
    weight: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket over all rows, and the number of rows."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for a, b, _, doc, bucket in ngrams(batch.column(0)):
                seen = np.zeros((b - a, BUCKETS), bool)
                seen[doc, bucket] = True
                df += seen.sum(0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], df]))], ["k", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    for r in texts.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        df[r["k"] + 1] = r["n"]
    return df[1:], int(df[0])


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal with an elastic net; rows: buckets and values of unit length."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def now(at):
        return np.where(np.abs(z[at]) > L1, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, v = rows[r]
            w = now(at)
            p = _softmax(v @ w)
            p[y[r]] -= 1
            g = v[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = now(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def train(docs: DataFrame) -> Language | None:
    """docs: doc_id, text, lang. None if no row has a language."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return None
    df, total = document_frequency(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    names = sorted(sizes)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000))
    quota = F.lit(0)
    for x in names:
        quota = F.when(F.col("lang") == x, int(1e9 * min(1, PER_LANGUAGE / sizes[x]))).otherwise(quota)
    picked = docs.filter(place < quota)

    def run(batches):
        for batch in batches:
            texts, got = batch.column(1), []
            for a, b, _, doc, bucket in ngrams(texts):
                tf = np.bincount(doc * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
                got += [(np.flatnonzero(r), r[r > 0]) for r in tf]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in got], pa.list_(pa.int32()))], ["place", "lang", "at", "tf"])

    rows = picked.select(place.alias("place"), "text", "lang").mapInArrow(run, "place long, lang string, at array<int>, tf array<int>").orderBy("place", "lang").toArrow()
    y = np.array([names.index(x) for x in rows["lang"].to_pylist()], int)
    data = []
    for at, tf in zip(rows["at"], rows["tf"], strict=True):
        at, tf = at.values.to_numpy(), tf.values.to_numpy()
        v = tf * idf[at]
        size = np.sqrt((v * v).sum())
        data.append((np.append(at, BUCKETS), np.append(v / (size or 1), 1.0)))
    held = np.arange(len(data)) % 5 == 4
    weight, bias = learn([data[r] for r in np.flatnonzero(~held)], y[~held], len(names))
    both = np.vstack([weight, bias])
    logits = np.stack([v @ both[at] for at, v in data]) if data else np.zeros((0, len(names)))
    check = held if held.any() else ~held
    losses = [(-np.log(np.maximum(_softmax(logits[check] / t)[np.arange(check.sum()), y[check]], 1e-12)).mean() if check.any() else 0.0, t) for t in np.geomspace(0.05, 20, 121)]
    return Language(names, idf, weight.astype(np.float32), bias, float(min(losses)[1]))


def predict(docs: DataFrame, model: Language | None) -> DataFrame:
    """docs with text and any other columns, plus lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        names = np.array([*(m.names if m else []), "und"], object)
        pred, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        for a, b, letter, doc, bucket in ngrams(texts):
            if m is None:
                score[a:b] = np.where(letter, 0.0, 1.0)
                continue
            tf = np.bincount(doc * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS).astype(np.float32)
            tf *= m.idf.astype(np.float32)
            size = np.sqrt(np.einsum("ij,ij->i", tf, tf))
            p = _softmax((tf @ m.weight / np.maximum(size, 1e-9)[:, None] + m.bias) / m.temperature)
            pred[a:b] = np.where(letter, p.argmax(1), len(names) - 1)
            score[a:b] = np.where(letter, p.max(1), 1.0)
        return [pa.array(names[pred].tolist(), pa.string()), pa.array(score)]

    return add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work)
