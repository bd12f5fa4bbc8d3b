"""Stages of corpus_pipeline.py against plain versions."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zastera.llm import fsjoin
from zastera.llm.queries import tokenizer_path

from .test_index import plain as plain_index
from .test_lines import plain as plain_lines


def changed(words, *at):
    return " ".join(f"z{k}" if k in at else w for k, w in enumerate(words))


A, B = ([f"{c}{k}" for k in range(60)] for c in "ab")
# Similarity on five and on three words: of 1 and 2 0.806 and 0.871, of 3 and 4 0.697 and 0.813, of 6 and 7 1.
TEXTS = [(1, " ".join(A)), (2, changed(A, 0, 55)), (3, " ".join(B)), (4, changed(B, 20, 40)), (5, None), (6, "one two three four"), (7, "One  two three four"), (8, "one two three")]


def groups(words, share):
    shingles = []
    for _, t in TEXTS:
        w = (t or "").lower().split()
        shingles.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return {k: min([k, *(j for (j, _), t in zip(TEXTS, shingles, strict=True) if s and 100 * len(s & t) >= share * len(s | t))]) for (k, _), s in zip(TEXTS, shingles, strict=True)}


@pytest.mark.parametrize("words, share", [(3, 90), (5, 80), (1, 80), (5, 60)])
def test_shingle_length_and_share(spark, words, share):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in fsjoin.near_duplicates(docs, share, words).collect()} == groups(words, share)


def test_near_duplicates_stage(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    want = groups(5, 80)
    assert sorted(r["doc_id"] for r in got.collect()) == [k for k in sorted(want) if want[k] == k] and want != groups(3, 90)


@pytest.mark.parametrize("share, most", [(80, 0.7), (90, 0.3)])
def test_similar_sets_share_one_of_few_signatures(share, most):
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    sizes, sent, held = fsjoin.Sizes(share), 0, 0
    for n in [*range(1, 60), 300, 1000] * 5:
        s, k = draw(n), int(n * (100 - share) / (100 + share))
        swapped = np.concatenate([s[k:], draw(k)])
        shorter = s[n - -(-n * share // 100) :]
        for t in (swapped, shorter):
            assert 100 * len(np.intersect1d(s, t)) >= share * len(np.union1d(s, t))
            for hot in (0.0, 0.05, 0.5, 1.0):
                is_hot = lambda x: np.isin(x, s[: int(len(s) * hot)])  # noqa: B023, E731
                a, b = (fsjoin.signatures(np.sort(x), is_hot(np.sort(x)), sizes) for x in (s, t))
                assert len(np.intersect1d(a, b))
        if n >= 300:
            sent, held = sent + len(fsjoin.signatures(np.sort(s), np.zeros(n, bool), sizes)), held + n
    assert sent < most * held


GOOD, BAD = "The quick fox ran home, and it slept well. ", "BUY $$$ NOW!!! ### "
ITEM = " ".join(f"q{k}" for k in range(30))
ROWS = [(k, (GOOD if k % 3 else BAD) * (1 + k % 5) + f"number {k}.\nline {k % 4} here\nanother {k % 4}\nthird {k % 4}") for k in range(60)]
ROWS += [(60, GOOD + ITEM), (61, None), (62, ""), (63, GOOD * 3 + " ".join(A)), (64, GOOD * 3 + " ".join(A) + " more"), (5, ROWS[5][1]), (None, GOOD * 2 + "no id"), (65, "same\nthree\nlines"), (66, "same\nthree\nlines")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "row", "x.y", "covered"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(45)], "doc_id long, quality int").withColumn("text", F.lit("clash")).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "zz yy xx")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_every_stage_on_its_own_input(spark, sf, tmp_path):
    """Each stage keeps the columns, and its rows are those of a plain version of what went in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
        out = stored(spark, stage(spark, docs, sf), tmp_path / f"{n}_{name}")
        assert out.columns == columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
        assert all(r["score"] == r["x.y"] == "clash" for r in out.collect())
        if name == "quality_classifier":
            assert set(map(str, got)) <= set(map(str, before)) and {k for k, t, _ in got if t and t.startswith("BUY")} == set()
            assert {k for k, t, _ in before if t and t.startswith("The")} == {k for k, t, _ in got if t and t.startswith("The")}
        elif name == "line_dedup":
            want = [(k, t) for (k, t, gone, lines) in ((k, t, gone, lines) for k, t, lines, gone in plain_lines([x[:2] for x in before])) if not gone or gone < lines]
            assert sorted(((k, t) for k, t, _ in got), key=str) == sorted(want, key=str)
            assert all(n == len(t or "") for _, t, n in got)
        elif name == "near_duplicates":
            shingles = []
            for _, t, _ in before:
                w = (t or "").lower().split()
                shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
            root = list(range(len(before)))
            for _ in before:
                for i, a in enumerate(shingles):
                    root[i] = min([root[i], *(root[j] for j, b in enumerate(shingles) if a and b and 100 * len(a & b) >= 80 * len(a | b))])
            first = {}
            for i, r in enumerate(root):
                first.setdefault(r, []).append(i)
            assert len(got) == len(first) and any(len(x) > 1 for x in first.values())
            for group in first.values():
                low = min((before[i][0] is not None, before[i][0] or 0) for i in group)
                assert sum((k is not None, k or 0) == low and t in {before[i][1] for i in group} for k, t, _ in got) >= 1
        else:
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            found = plain_index([x[:2] for x in before], bench)
            want = [x for x, (words, hit, _, _) in zip(before, found, strict=True) if not (hit > 0 and 20 * hit >= words)]
            assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) < len(before)
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    want = [(k, len(whole.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in ((r["doc_id"], r["text"]) for r in docs.collect())]
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in last), key=str) == sorted(want, key=str)
    key = lambda r: (str(r["doc_id"]), r["ids_sha256"])
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, last))


def test_empty_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = stored(spark, docs.limit(0), tmp_path / "none")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/sf/{name}.parquet")
    assert rows_of(corpus_pipeline.quality_classifier(spark, docs, f"{tmp_path}/sf")) == rows_of(docs) == rows_of(corpus_pipeline.decontamination(spark, docs, f"{tmp_path}/sf"))


def test_odd_rows_of_the_jaccard_join(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d e f"), (2, "C D e f"), (3, None)], "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("sig", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in fsjoin.near_duplicates(docs).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 2, "2"), ("3", 0, "3"), ("None", 2, "2")]
    assert fsjoin.near_duplicates(docs.limit(0)).collect() == []
