"""Word-shingle Jaccard self-join by vertical partitioning.

A document is its set of distinct shingles of WORDS words, or as many as the caller says (a shorter one the one
shingle of all its words). Shingles have a global order, that of their 64-bit hashes, and the order is cut into fragments.

1. Documents with equal sets form a class (128-bit fingerprint of the set); one represents it.
2. The order is that of the hashes, but shingles that occur in many documents (HOT or more; at most MOST_HOT of
   them, counted over all rows) come last, as a fragment of their own. Two sets of SHARE % similarity differ in at
   most d shingles, d by the smaller's size, so in at most d fragments. If one of them holds shingles in d + 1 others
   than the hot one, they agree in one that isn't empty; cuts have some fragments to spare for that. Each set sends a
   hash of every fragment it holds shingles of, for its own size class and the one below. A set that holds shingles
   in fewer sends those of another cut too, and after LEVELS cuts those of all its shingles, of the empty fragments as
   well: two similar sets that both hold too few both do so, and meet.
3. Groups of sets with an equal fragment are taken once each, though they share many. Every member is first paired
   with the group's first. Groups that are then still of several components are cut into blocks of BLOCK sets, and
   every pair of blocks is compared in one task by sketches: SKETCH bits, each the parity of the shingles that hash to
   it, differ in no more bits than the sets in shingles. A set names the closest of the sets of other components that
   it may be similar to: in a round some FIRST of them, in a later one more, and in the last round all; rounds end
   when no set had more to name. What a round links is one component in the next, and asks for nothing any more. So
   all pairs of a group are judged, but none are written out that sketches or components rule out.
4. A pair's overlap is counted in each of PARTS fragments separately and summed; the exact rule decides.
5. Components of the links, and every copy back to its class.

Texts without words are linked with nothing. Null and repeated ids and rows are kept: rows are told apart by
monotonically_increasing_id() over docs, which has to read the same way twice.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import MOST_IDS, discard, prepare, scratch
from .components import components
from .hmm import frequent

WORDS, SHARE, PARTS, LEVELS, BLOCK, HOT, MOST_HOT, SKETCH, FIRST = 3, 90, 4, 6, 2048, 16, 2_000_000, 2048, (4, 64, None)


class Sizes:
    """Size classes such that sets of SHARE % similarity are of the same class or of neighbours."""

    def __init__(self, share: int):
        self.share, self.low = share, [1]

    def _grow(self) -> None:
        b = self.low[-1]
        self.low.append(max(b + 1, (b - 1) * 100 // self.share + 1))

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self._grow()
        return bisect_right(self.low, n) - 1

    def fragments(self, k: int) -> tuple[int, int]:
        """Fragments of a cut, and how many of them must hold shingles so that similar sets agree in one that does.

        Those to spare are three times the empty ones expected.
        """
        while len(self.low) < k + 2:
            self._grow()
        most = self.low[k + 1] - 1  # of the smaller set; the union is at most 100 / share of it
        least = most * (100 - self.share) // self.share + 1
        return least + int(3 * least * math.exp(-self.low[k] / least) + 0.5), least


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of shingles of so many words, sorted."""
    if len(h) < words:
        return K.combine(*(h[k : k + 1] for k in range(len(h))))[:1] if len(h) else h
    return np.unique(K.combine(*(h[k : len(h) - words + 1 + k] for k in range(words))))


def _cut(s: np.ndarray, f: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each of f fragments of sorted hashes, and whether it holds any."""
    cuts = np.arange(1, f, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // f)
    bound = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return K.combine(total[bound[1:]] - total[bound[:-1]], K.mix(np.arange(f, dtype=np.uint64) + np.uint64(salt))), bound[1:] > bound[:-1]


def signatures(s: np.ndarray, hot: np.ndarray, sizes: Sizes) -> np.ndarray:
    own = sizes.of(len(s))
    cold = s[~hot]
    out = []
    for k in {own, max(own - 1, 0)}:
        f, least = sizes.fragments(k)
        for level in range(LEVELS):
            order = cold if level == 0 else np.sort(K.mix(cold + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            sig, full = _cut(order, f, k << 32 | level << 28)
            out.append(sig[full])
            if full.sum() >= least:
                break
        else:
            out.append(_cut(s, f, k << 32 | LEVELS << 28)[0])
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of SKETCH bits, the parity of the shingles that hash to it, as longs."""
    bit = (K.mix(s ^ np.uint64(0x5BF03635D1C6A9E7)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def _rows(batch: pa.RecordBatch, words: int):
    for _, _, data, off in K.chunks(batch.column("text")):
        w = K.words(data, off, K.SPACED_LOWER)
        for a, b in zip(w.off[:-1], w.off[1:], strict=True):
            yield shingles(w.hash[a:b], words)


def hot_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of HOT documents or more, as far as single tasks see them twice; the MOST_HOT most frequent."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def twice():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        for batch in batches:
            for s in _rows(batch, words):
                held.append(s)
                size += len(s)
            if size > 1 << 20:
                yield twice()
                held, size = [], 0
        if held:
            yield twice()

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(f"n >= {HOT}")
    counts = scratch(counts, "hot")
    return np.sort(frequent(counts, MOST_HOT).toArrow()["h"].to_numpy().view(np.uint64))


def sets(docs: DataFrame, share: int, words: int) -> DataFrame:
    """(row, doc_id, n, f1, f2, sketch, sigs) of docs (row, doc_id, text)."""

    shared = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, words))

    def run(batches):
        sizes, hot = Sizes(share), K.HashIndex(shared.value)
        for batch in batches:
            n, f1, f2, bits, sigs = [], [], [], [], []
            for s in _rows(batch, words):
                n.append(len(s))
                f1.append(int(K.mix(s).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(K.mix(s ^ np.uint64(0x0123456789ABCDEF)).sum(dtype=np.uint64).view(np.int64)))
                bits.append(sketch(s))
                sigs.append(signatures(s, hot.find(s) >= 0, sizes).view(np.int64) if len(s) else np.zeros(0, np.int64))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([*sigs, np.zeros(0, np.int64)])))], ["row", "doc_id", "n", "f1", "f2", "sketch", "sigs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n long, f1 long, f2 long, sketch array<long>, sigs array<long>")


def fragments(docs: DataFrame, rows: DataFrame, words: int, parts: int = PARTS) -> DataFrame:
    """(row, part, items) of the documents whose row is in rows: the hashes of each fragment of the order."""
    spark = docs.sparkSession
    if rows.count() <= MOST_IDS:
        wanted = spark.sparkContext.broadcast(np.sort(rows.toArrow()["row"].to_numpy()))
    else:
        docs, wanted = docs.join(rows, "row", "left_semi"), None

    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column("row").to_numpy(), wanted.value)))
            row, items = [], []
            cuts = np.arange(1, parts, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // parts)
            for r, s in zip(batch.column("row").to_pylist(), _rows(batch, words), strict=True):
                row.append(r)
                items += np.split(s.view(np.int64), np.searchsorted(s, cuts))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(row, np.int64), parts)), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(row))), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([*items, np.zeros(0, np.int64)])))], ["row", "part", "items"])

    return docs.select("row", "text").mapInArrow(run, "row long, part int, items array<long>")


def linked(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, share: int, words: int) -> DataFrame:
    """Those of pairs (a, b) whose documents are similar enough."""
    rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    parts = scratch(fragments(docs, rows, words), "fragments")
    left = pairs.join(parts.select(F.col("row").alias("a"), "part", F.col("items").alias("x")), "a")
    both = left.join(parts.select(F.col("row").alias("b"), "part", F.col("items").alias("y")), ["b", "part"])
    partial = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"))
    common = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
    n = lambda c: sizes.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"))
    found = scratch(common.join(n("a"), "a").join(n("b"), "b").filter(f"100 * common >= {share} * (n_a + n_b - common)").select("a", "b"), "links")
    discard(parts)
    return found


def _apart(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, row, root, block, blocks) of the groups of three or more whose members aren't all of one component.

    A group's first has been compared with all others, so two are done.
    """
    member = groups.select("sig", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").select("sig", "row", F.coalesce("root", "row").alias("root"))
    split = member.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high AND n > 2").select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return member.join(split, "sig").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))


def survivors(x: np.ndarray, y: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row of x and one of y of another root that may be similar by sizes and sketches, and in how many bits they differ."""
    found = []
    head = 8  # words of a sketch that settle most pairs
    for k in range(0, len(x), 256):
        own = x[k : k + 256]
        most = (n[own][:, None] + n[y][None, :]) * (100 - share) // (100 + share)
        may = (root[own][:, None] != root[y][None, :]) & (np.abs(n[own][:, None] - n[y][None, :]) <= most)
        i, j = np.nonzero(may)
        for at in range(0, len(i), 1 << 17):
            a, b, top = own[i[at : at + (1 << 17)]], y[j[at : at + (1 << 17)]], most[i[at : at + (1 << 17)], j[at : at + (1 << 17)]]
            differ = np.bitwise_count(bits[a, :head] ^ bits[b, :head]).sum(1, dtype=np.int64)
            near = differ <= top
            a, b, top, differ = a[near], b[near], top[near], differ[near]
            differ += np.bitwise_count(bits[a, head:] ^ bits[b, head:]).sum(1, dtype=np.int64)
            near = differ <= top
            found.append((a[near], b[near], differ[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def closest(a: np.ndarray, b: np.ndarray, differ: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` closest b of each a, and whether that a had more."""
    order = np.lexsort((b, differ, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
    size = np.diff(np.append(first, len(a)))
    nth = np.arange(len(a)) - np.repeat(first, size)
    keep = nth < (len(a) if most is None else most)
    return a[keep], b[keep], (np.repeat(size, size) > (len(a) if most is None else most))[keep]


def candidates(apart: DataFrame, sketches: DataFrame, share: int, most: int | None) -> DataFrame:
    """(a, b, more): pairs of rows of other components that may be similar, the `most` closest of each row in each pair of blocks. sketches: (row, n, sketch)."""
    sides = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    sent = apart.join(sketches, "row").select("sig", "row", "root", "n", "sketch", "block", sides.alias("x")).select("sig", "x.i", "x.j", "block", "row", "root", "n", "sketch")
    key = ["sig", "i", "j"]

    def judge(t: pa.Table):
        row, root, n = (t[c].to_numpy() for c in ("row", "root", "n"))
        bits = t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64)
        first = t["block"].to_numpy() == t["i"][0].as_py()
        if t["i"][0].as_py() == t["j"][0].as_py():
            # The rows of the largest component needn't be compared among themselves.
            roots, at, size = np.unique(root, return_inverse=True, return_counts=True)
            x, y = np.flatnonzero(at != size.argmax()), np.arange(len(row))
        else:
            x, y = np.flatnonzero(first), np.flatnonzero(~first)
        a, b, differ = survivors(x, y, root, n, bits, share)
        a, b, differ = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([differ, differ])
        a, b, more = closest(a, b, differ, most)
        if len(a):
            low, high = np.minimum(row[a], row[b]), np.maximum(row[a], row[b])
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(more)], ["a", "b", "more"])

    def run(batches):
        held = None  # the last group so far, at most two blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            start = np.zeros(t.num_rows, bool)
            start[0] = True
            for c in key:
                x = t[c].to_numpy()
                start[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(start).tolist()
            for u, v in zip(at, at[1:], strict=False):
                yield from judge(t.slice(u, v - u))
            held = t.slice(at[-1])
        if held is not None:
            yield from judge(held)

    found = sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def near_duplicates(docs: DataFrame, share: int = SHARE, words: int = WORDS) -> DataFrame:
    """doc_id, row, n_shingles, class_id (smallest id with the same set), component_id and root (a row) of each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    every = scratch(sets(docs, share, words), "sets")
    known = scratch(every.drop("sigs"), "known")
    key = ["f1", "f2", "n"]
    classes = scratch(known.filter("n > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.min("doc_id").alias("class_id")), "classes")
    reps = classes.select(F.col("rep").alias("row"))
    reps = F.broadcast(reps) if reps.count() <= MOST_IDS else reps
    # One shuffle: a set sends many signatures, each once, so none has more than a small share of the rows; groups spill.
    same = Window.partitionBy("sig")
    sigs = every.filter("n > 0").join(reps, "row", "left_semi").select("row", F.explode("sigs").alias("sig"))
    groups = scratch(sigs.select("sig", "row", F.min("row").over(same).alias("first"), F.max("row").over(same).alias("last")).filter("first < last").drop("last"), "groups")
    discard(every)
    # Groups of the same members are one.
    mark = F.sum(F.xxhash64("row").cast("decimal(38,0)"))
    once = groups.groupBy("sig").agg(mark.alias("mark"), F.count("*").alias("size"), F.min("first").alias("first")).groupBy("mark", "size", "first").agg(F.min("sig").alias("sig")).select("sig")
    groups = scratch(groups.join(once, "sig", "left_semi"), "groups")
    sizes = known.select("row", "n")
    pairs = scratch(groups.filter("row > first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    roots = None
    if not pairs.isEmpty():
        links = linked(pairs, docs, sizes, share, words)
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = scratch(components(edges), "roots")
        for most in FIRST:
            close = scratch(candidates(_apart(groups, roots), known.select("row", "n", "sketch"), share, most), "close")
            if close.isEmpty():
                break
            more = linked(close.select("a", "b"), docs, sizes, share, words).select(F.col("a").alias("u"), F.col("b").alias("v"))
            if not more.isEmpty():
                edges = edges.unionByName(more)
                roots = scratch(components(edges), "roots")
            if close.filter("more").isEmpty():
                break
        discard(groups)
    if roots is not None:
        classes = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
        classes = classes.join(least, "root").select(*key, "class_id", "component_id", "root")
    else:
        classes = classes.select(*key, "class_id", F.col("class_id").alias("component_id"), F.col("rep").alias("root"))
    return known.select("row", "doc_id", *key).join(classes, key, "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "row").alias("root"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM r JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (
  WITH RECURSIVE t(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.id) SELECT id, min(c) AS c FROM t GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN t ON t.id = d.doc_id
"""
