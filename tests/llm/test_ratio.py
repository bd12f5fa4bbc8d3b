"""n-gram ratio and base rules against plain versions, for every document."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from zastera.llm import ratio


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(words):
    """Hashes of words and of pairs of them, as Spark's xxhash64 gives them."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    pairs = []
    for a, b in zip(h, h[1:], strict=False):
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
        pairs.append(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), first))
    return [signed(x) % ratio.BUCKETS for x in [*h, *pairs]]


def base(text):
    words = split(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


RND = random.Random(1)
WORDS = [f"w{k}" for k in range(40)] + ["é", "日本", "#x", "$$"]
ROWS = [(k, " ".join(RND.choice(WORDS if k % 2 else WORDS[:12]) + RND.choice(["", "", ".", "\n"]) for _ in range(RND.choice([3, 49, 50, 51, 120])))) for k in range(60)]
ROWS += [(5, ROWS[5][1]), (None, ROWS[6][1]), (100, None), (101, ""), (102, "a b c " * 4000), (103, "\n\n \t\n"), (104, "x\ny\nx\n x\n" * 20)]
LABELS = [(k, int(k % 4 != 1)) for k in range(0, 50)] + [(2, 1), (3, 0), (3, 1), (None, 1), (7, None), (9999, 1)]


def test_every_column_is_the_plain_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("good", F.lit(5))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    good = {k for k, _ in LABELS if k is not None and {q for j, q in LABELS if j == k and q is not None} == {1}}
    raw, target = Counter(), Counter()
    for k, t in ROWS:
        raw.update(buckets(split(t)))
        target.update(buckets(split(t)) if k in good else [])
    all_raw, all_target = sum(raw.values()) + ratio.BUCKETS, sum(target.values()) + ratio.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / all_target * all_raw / (raw[b] + 1))
    table = ratio.weights(docs, labels)
    assert max(abs(table[b] - weight(b)) for b in raw) < 1e-9
    got = ratio.judge(docs, table).collect()
    want = []
    for k, t in ROWS:
        b, own = buckets(split(t)), base(t)
        mean = sum(map(weight, b)) / len(b) if b else 0.0
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        want.append((k, *own, failed, not failed and mean >= ratio.THRESHOLD, mean))
    key = lambda r: (str(r[0]), r[1:6])
    rows = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], r["ratio"]) for r in got), key=key)
    for a, b in zip(rows, sorted(want, key=key), strict=True):
        assert a[:7] == b[:7] and a[8] == pytest.approx(b[8], abs=1e-4)
        assert a[7] == b[7] or abs(b[8] - ratio.THRESHOLD) < 1e-4
    assert {x[7] for x in want} == {True, False} and sum(not x[6] for x in want) > 10


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(ROWS[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    none = ratio.weights(docs.limit(0), labels)
    assert set(none) == {0.0} and ratio.judge(docs.limit(0), none).collect() == []
    assert len(ratio.judge(docs, ratio.weights(docs, labels)).collect()) == 3
