"""Line dedup against a plain version, with hot windows and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from zastera.llm import linededup

BLANK = " \t\r\x0b\x0c"


def plain(rows):
    """rows: (doc_id, place, text), in order of doc_id and place."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    later = [set() for _ in rows]
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(BLANK)]
        for i in range(max(1, len(real) - 2) if real else 0):
            at = real[i : i + 3]
            window = tuple(lines[j].strip(BLANK) for j in at)
            if window in seen:
                later[k].update(at)
            seen.add(window)
        text = rows[k][1]
        out[k] = (rows[k][0], text if not later[k] else "\n".join(x for i, x in enumerate(lines) if i not in later[k]), len(real) if text is not None else 0, len(later[k]))
    return out


@pytest.mark.parametrize("hot", [1000, 4])
def test_dedup_is_the_plain_one(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rnd = random.Random(3)
    pool = ["a", "b", "c ", "  a", "", "\t", "d", "x\r"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(12)))) for k in range(120)]
    rows += [(7, rows[7][1]), (None, "a\nb\nd"), (None, "q\nr\ns"), (200, None), (201, ""), (202, "hot\nline\nhere"), *((300 + k, "hot\nline\nhere\nand\nthis") for k in range(60)), (400, "l\n" * 20_000 + "end")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("covered", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("first", F.lit(2)).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    key = lambda r: tuple(map(str, r))
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(docs).collect()]
    assert sorted(got, key=key) == sorted(plain([(r["doc_id"], r["text"]) for r in docs.collect()]), key=key)


def test_empty_table_and_columns_that_travel(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, n_removed int")
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
    assert linededup.dedup_lines(docs).first()["doc"]["n_removed"] == 5
