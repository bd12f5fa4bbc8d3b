"""Line dedup over overlapping windows of three consecutive lines, with DataFrame functions only.

A line's key is the line without surrounding ASCII white space; blank lines belong to no window and always stay.
A text of one or two lines that are not blank is one window of its own. Equal windows are found over the whole
table by a 128-bit hash (two seeds); the first by (doc_id, row, place) stays. The lines that any later one covers,
merged, go.

First places come from a map-side minimum. Places of a window meet it in a join by hash, but windows that hold more
than a HOT-th of all places (so there are at most HOT of them) meet it in a broadcast: no task gets them all.

Null texts stay null; empty tables give no rows; repeated rows are rows of their own, the later of which loses
its lines; null ids come first; texts are read whole, and columns other than doc_id and text only travel in doc,
whatever they are called. Rows are told apart by monotonically_increasing_id(), so docs has to be a table that reads
the same way twice (files, not the result of a shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

WINDOW, HOT = 3, 1000
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    """(pos, key) of the lines that aren't blank."""
    every = F.transform(_lines(text), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(BLANK)).alias("key")))
    return F.filter(every, lambda x: x["key"] != "")


def windows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, places, h1, h2): places are the window's line numbers in the text."""

    def window(keys: Column, i: Column) -> Column:
        at = [F.get(keys, i + k) for k in range(WINDOW)]
        parts = [x["key"] for x in at]
        return F.struct(F.filter(F.array(*(x["pos"] for x in at)), lambda x: x.isNotNull()).alias("places"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _keys(F.col("text")).alias("keys")).filter(F.size("keys") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("keys") - WINDOW, F.lit(0)))
    return rows.select("row", "doc_id", F.explode(F.transform(starts, lambda i: window(F.col("keys"), i))).alias("w")).select("row", "doc_id", "w.*")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) as doc_id, text, n_lines (not blank), n_removed, doc (all columns as they were); one row for each."""
    docs = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    found = scratch(windows(docs), "windows")
    place = F.struct("doc_id", "row", F.col("places")[0].alias("at"))
    first = scratch(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    most = found.count() // HOT
    hot = F.broadcast(first.filter(F.col("n") > most).drop("n"))
    cold = first.filter(F.col("n") <= most).drop("n")
    met = found.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]).unionByName(found.join(hot, ["h1", "h2"]))
    later = met.filter(~((F.col("row") == F.col("first.row")) & (F.col("places")[0] == F.col("first.at"))))
    covered = later.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("covered"))
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    clean = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    rows = docs.withColumn("row", F.monotonically_increasing_id()).join(covered, "row", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(clean).alias("text"),
        F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        "doc",
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM l WHERE key <> ''),
w AS (
  SELECT doc_id, r, c, pos, lead(pos) OVER d AS pos1, lead(pos, 2) OVER d AS pos2, key, lead(key) OVER d AS key1, lead(key, 2) OVER d AS key2
  FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), v AS (
  SELECT *, row_number() OVER (PARTITION BY key, key1, key2 ORDER BY doc_id, pos) AS nth FROM w WHERE r <= greatest(c - 2, 1)
), covered AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT doc_id, pos FROM v WHERE nth > 1 UNION ALL SELECT doc_id, pos1 FROM v WHERE nth > 1 UNION ALL SELECT doc_id, pos2 FROM v WHERE nth > 1
  ) WHERE pos IS NOT NULL
), lines AS (
  SELECT doc_id, i - 1 AS pos, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  (SELECT count(*) FROM k WHERE k.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM covered c WHERE c.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""
