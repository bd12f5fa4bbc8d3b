"""Licence scan against a plain search of phrases and of interrupted templates."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from zastera.llm import automaton
from zastera.llm import kernel as K

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scanner(templates=automaton.TEMPLATES, base=automaton.BASE):
    return automaton.Scanner(templates, base)


def scan(s, text):
    import pyarrow as pa

    _, _, data, off = next(K.chunks(pa.array([text])))
    return s.scan(s.index.find(K.words(data, off, K.LETTERS_LOWER).hash))


def base_places(words):
    out = []
    for phrase in automaton.BASE:
        p = phrase.split()
        out += [(phrase, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return out


def test_base_columns_are_a_plain_search(spark):
    rnd = random.Random(4)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "é", "CC", "By"]
    texts = [" ".join(rnd.choice(pool) for _ in range(n)) for n in [*range(12), 400, 400]] + [None, "", "cc-by; CC BY", "x " * 30_000 + "all rights reserved"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[12])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("score", F.lit(9))
    got = sorted(automaton.scan(docs).collect(), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    assert len(got) == len(rows)
    for r, (k, t) in zip(got, sorted(rows, key=lambda x: (str(x[0]), len(split(x[1])))), strict=True):
        places = base_places(split(t))
        starts = [i for _, i in places]
        labels = {automaton.BASE[p] for p, _ in places}
        assert (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (k, len(split(t)), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("k", range(len(automaton.TEMPLATES)))
def test_each_template_is_found_whole_and_changed(k):
    s, (label, text) = scanner(), automaton.TEMPLATES[k]
    words = text.split()
    whole = [x for x in scan(s, "lead in " + text + " and out")[1] if x[0] == label and x[1] <= 2 and x[2] >= 2 + len(words)]
    assert whole and max(x[3] for x in whole) == 1
    if len(words) >= 20:
        inserted = [*words[:9], "zzz", "yyy", *words[9:]]
        changed = [*words[:9], "zzz", *words[10:]]
        assert any(x[0] == label and x[3] == 1 for x in scan(s, " ".join(inserted))[1])
        assert any(x[0] == label and x[3] >= (len(words) - 3) / len(words) - 1e-9 for x in scan(s, " ".join(changed))[1])
        half = scan(scanner([(label, text)]), " ".join(words[: len(words) // 2]))[1]
        assert half == []


def test_a_run_that_is_longer_in_another_template_counts_for_both():
    text = "provided that the above copyright notice and this permission notice must be included in all copies or substantial portions of the software"
    assert "mit" in {x[0] for x in scan(scanner(), text)[1]}


def test_gap_bounds_a_chain():
    s = scanner([("t", "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10")])
    at = lambda n: scan(s, "a1 a2 a3 a4 a5 " + "z " * n + "a6 a7 a8 a9 a10")[1]
    assert at(automaton.GAP) == [("t", 0, 10 + automaton.GAP, 1.0)] and at(automaton.GAP + 1) == []
    assert scan(s, "a6 a7 a8 a9 a10 a1 a2 a3 a4 a5")[1] == []


def test_matching_statistics_are_the_longest_suffixes():
    rnd = random.Random(5)
    seqs = [[rnd.randrange(3) for _ in range(n)] for n in (7, 9, 4)]
    own = {tuple(x[i:j]) for x in seqs for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    a = automaton.Automaton(seqs)
    text = [rnd.randrange(4) for _ in range(300)]
    for i, (v, size) in enumerate(a.statistics(text)):
        assert size == max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in own), default=0)
        if v:
            ends = {(k, e) for k, x in enumerate(seqs) for e in range(size, len(x) + 1) if x[e - size : e] == text[i + 1 - size : i + 1]}
            assert set(a.ends[v]) == ends


def test_work_grows_with_the_text():
    s, took = scanner(), []
    scan(s, "licensed under the zzz")
    for n in (2_000, 16_000):
        began = time.perf_counter()
        scan(s, "licensed under the zzz " * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]


def test_empty_table(spark):
    assert automaton.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert np.array(scan(scanner(), "")[0]).size == 0
