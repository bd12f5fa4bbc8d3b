"""Benchmark decontamination with a distributed positional inverted index.

1. `index` stores the postings: for each document, its terms and the places of each, as a scratch table partitioned by
   document. Up to MOST_TERMS different benchmark words, only those are stored; beyond, every word is.
2. `windows` cuts the benchmark on the executors into windows (WINDOW consecutive words, or all words of a shorter
   item), each once, with the items it stands in. They are searched in blocks of at most BLOCK words, one broadcast each;
   every block meets every document's postings, and the texts are read once however many blocks there are.
3. `search` takes each window's terms from the rarest one in the corpus on and intersects their lists of places,
   shifted by the terms' offsets. What survives all terms is an exact phrase. A proximity match is a start at which
   one of the window's rarest terms stands in place and at least NEAR of all terms stand within SLACK words of
   theirs; as many rarest terms are tried as may be missing, and one more, so one changed word hides no window.
   Starts of one window that lie SLACK words apart or less are one match, and none within SLACK of an exact one
   counts. At most STEP candidates are held at a time.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; a word's identity is its 64-bit hash.
Null and empty texts have no words and no hits; null and empty items no windows; an item whose id is null counts for
hits but not among the items; items of the same id are one. Repeated rows are rows of their own; an empty benchmark
hits nothing, no documents give no rows. Only doc_id and text of docs, and item_id and text of the benchmark, are
read, whatever other columns are called. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, prepare, scratch

WINDOW, BLOCK, MOST_TERMS, SLACK, NEAR, STEP = 13, 1_000_000, 4_000_000, 2, 0.8, 1 << 18
#: Places between two documents of a batch, more than any window reaches.
APART = WINDOW + 2 * SLACK + 1


class Windows(NamedTuple):
    """A block's distinct windows, and the terms as hashes."""

    terms: np.ndarray
    window: np.ndarray  # windows x WINDOW: term, or -1
    size: np.ndarray
    order: np.ndarray  # windows x WINDOW: offsets, rarest term first
    item_cut: np.ndarray  # window to places in items
    items: np.ndarray
    names: list[str]  # of the items


def windows(benchmark: DataFrame) -> DataFrame:
    """(w, items) of benchmark (item_id, text): each distinct window's hashes and the ids of its items."""

    def run(batches):
        for batch in batches:
            ids, out, own = batch.column(0).to_pylist(), [], []
            for i, _, data, off in K.chunks(batch.column(1)):
                w = K.words(data, off, K.LETTERS_LOWER)
                for k, (a, b) in enumerate(zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)):
                    for s in range(a, max(a + 1, b - WINDOW + 1) if b > a else a):
                        out.append(w.hash[s : min(b, s + WINDOW)].view(np.int64))
                        own.append(ids[i + k])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())), pa.array(own, pa.string())], ["w", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "w array<long>, item string")
    return rows.groupBy("w").agg(F.collect_set("item").alias("items"))


def blocks(found: DataFrame) -> Iterator[Windows]:
    """A stored table of windows, BLOCK words at a time; as many items of one window as are named in it."""
    rows: list[tuple[list[int], list[str]]] = []
    held = 0
    for r in found.toLocalIterator():
        rows.append((r["w"], r["items"]))
        held += len(r["w"]) + len(r["items"])
        if held >= BLOCK:
            yield _block(rows)
            rows, held = [], 0
    if rows:
        yield _block(rows)


def _block(rows: list[tuple[list[int], list[str]]]) -> Windows:
    names = sorted({x for _, items in rows for x in items})
    place = {x: k for k, x in enumerate(names)}
    size = np.array([len(w) for w, _ in rows], np.int64)
    flat = np.array([x for w, _ in rows for x in w], np.int64).view(np.uint64)
    terms = np.unique(flat)
    window = np.full((len(rows), WINDOW), -1, np.int32)
    window[np.arange(WINDOW)[None, :] < size[:, None]] = np.searchsorted(terms, flat)
    cut = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]).astype(np.int64)
    return Windows(terms, window, size, np.zeros(window.shape, np.int8), cut, np.array([place[x] for _, items in rows for x in items], np.int32), names)


_POSTINGS = "row long, doc_id {kind}, n_words long, terms array<long>, n array<int>, places array<int>"


def index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The postings of docs (row, doc_id, text): its terms (of the vocabulary, if given), how often each stands there, and where."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = None if shared.value is None else K.HashIndex(shared.value)
        for batch in batches:
            n_words, n_terms, terms, counts, n_places, places = [], [], [], [], [], []
            for _, _, data, off in K.chunks(batch.column("text")):
                w = K.words(data, off, K.LETTERS_LOWER)
                at = np.arange(len(w.hash)) if known is None else np.flatnonzero(known.find(w.hash) >= 0)
                at = at[np.lexsort((w.hash[at], w.doc[at]))]  # stable, so that places ascend
                h, doc = w.hash[at], w.doc[at]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else at
                size = len(off) - 1
                n_words.append(np.diff(w.off))
                n_terms.append(np.bincount(doc[first], minlength=size))
                n_places.append(np.bincount(doc, minlength=size))
                terms.append(h[first].view(np.int64))
                counts.append(np.diff(np.append(first, len(at))).astype(np.int32))
                places.append((at - w.off[doc]).astype(np.int32))
            lists = lambda n, x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int32)), pa.array(np.concatenate(x), kind)) if n else pa.array([], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), lists(n_terms, terms, pa.int64()), lists(n_terms, counts, pa.int32()), lists(n_places, places, pa.int32())],
                ["row", "doc_id", "n_words", "terms", "n", "places"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, _POSTINGS.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    return off - off[0] if len(off) else np.zeros(1, np.int32), column.flatten().to_numpy()


def count_terms(postings: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted terms occurs in all texts."""
    shared = postings.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known, total = K.HashIndex(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            at, n = known.find(_numbers(batch.column(0))[1].view(np.uint64)), _numbers(batch.column(1))[1]
            total += np.bincount(at[at >= 0], n[at >= 0], len(total)).astype(np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    got = postings.select("terms", "n").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(terms), np.int64)
    n[got["k"].to_numpy()] = got["n"].to_numpy()
    return n


def _rarest_first(block: Windows, n: np.ndarray) -> np.ndarray:
    often = np.where(block.window >= 0, n[block.window] if len(n) else 0, np.iinfo(np.int64).max)
    return np.argsort(often, axis=1, kind="stable").astype(np.int8)


def _needed(size: np.ndarray) -> np.ndarray:
    """How many of a window's terms a proximity match has."""
    return np.ceil(NEAR * size - 1e-9).astype(np.int64)


class Searcher:
    """Windows of one block in the postings of some documents."""

    def __init__(self, block: Windows):
        self.block, self.known = block, K.HashIndex(block.terms)
        missing = block.size - _needed(block.size)
        self.anchors = []  # for the k-th rarest term: windows by that term, and where each term's begin
        for k in range(int(missing.max(initial=0)) + 1):
            use = np.flatnonzero(missing >= k)
            term = block.window[use, block.order[use, k]]
            order = np.argsort(term, kind="stable")
            self.anchors.append((use[order], np.searchsorted(term[order], np.arange(len(block.terms) + 1))))

    def load(self, term: np.ndarray, place: np.ndarray, room: int) -> None:
        """Postings: term (-1: none of the block's) and place, all below room."""
        keep = term >= 0
        self.room = room
        self.keys = np.sort(term[keep].astype(np.int64) * room + place[keep])

    def _candidates(self, k: int):
        """(window, start) of the places of the windows' k-th rarest terms, at most STEP at a time."""
        windows, cut = self.anchors[k]
        term, place = self.keys // self.room, self.keys % self.room
        n = cut[term + 1] - cut[term]
        some = np.flatnonzero(n)
        term, place, end = term[some], place[some], np.cumsum(n[some])
        for a in range(0, int(end[-1]) if len(end) else 0, STEP):
            flat = np.arange(a, min(a + STEP, int(end[-1])))
            at = np.searchsorted(end, flat, "right")
            v = windows[cut[term[at] + 1] - (end[at] - flat)]
            yield v, place[at] - self.block.order[v, k]

    def _there(self, v: np.ndarray, s: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Whether the k-th rarest term of window v stands within slack words of its place; True beyond the window's terms."""
        off = self.block.order[v, k]
        base = self.block.window[v, off].astype(np.int64) * self.room + s + off
        at = np.searchsorted(self.keys, base - slack)
        return (k >= self.block.size[v]) | (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + slack) & (at < len(self.keys))

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of every exact phrase."""
        found = []
        for v, s in self._candidates(0):
            for k in range(1, WINDOW):
                fits = self._there(v, s, k, 0)
                v, s = v[fits], s[fits]
            found.append((v, s))
        return _joined(found)

    def near(self, v0: np.ndarray, s0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of every proximity match; v0, s0: the exact ones."""
        found, allowed = [], self.block.size - _needed(self.block.size)
        for anchor in range(len(self.anchors)):
            for v, s in self._candidates(anchor):
                lost = np.zeros(len(v), np.int64)
                for k in range(WINDOW):
                    lost += ~self._there(v, s, k, SLACK)
                    fits = lost <= allowed[v]
                    v, s, lost = v[fits], s[fits], lost[fits]
                found.append((v, s))
        v, s = _joined(found)
        # Windows lie more than SLACK starts apart, so that none meets another's.
        room = self.room + 2 * APART
        key = np.unique(v.astype(np.int64) * room + s + APART)
        exact = np.sort(v0.astype(np.int64) * room + s0 + APART)
        key = key[np.searchsorted(exact, key - SLACK) == np.searchsorted(exact, key + SLACK, "right")]
        key = key[np.concatenate([[True], np.diff(key) > SLACK])[: len(key)]]
        return key // room, key % room - APART


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])) if parts else (np.zeros(0, np.int64),) * 2


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_NEAR = pa.struct([("item", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_FOUND = "row long, doc_id {kind}, n_words long, spans array<struct<start: long, stop: long>>, items array<string>, near array<struct<item: string, start: long, stop: long>>"


def search(postings: DataFrame, block: Windows) -> DataFrame:
    """For each document of a stored index: merged spans of exact phrases, ids of their items, and proximity matches (item, start, stop)."""
    block = block._replace(order=_rarest_first(block, count_terms(postings, block.terms)))
    shared = postings.sparkSession.sparkContext.broadcast(block)

    def some(batch: pa.RecordBatch, searcher: Searcher) -> pa.RecordBatch:
        b, size = searcher.block, batch.num_rows
        n_words = batch.column("n_words").to_numpy()
        base = APART + np.concatenate([[0], np.cumsum(n_words + APART)]).astype(np.int64)
        cut, terms = _numbers(batch.column("terms"))
        _, n = _numbers(batch.column("n"))
        own, places = _numbers(batch.column("places"))
        doc = np.repeat(np.arange(size), np.diff(own))
        searcher.load(np.repeat(searcher.known.find(terms.view(np.uint64)), n), places + base[doc], int(base[-1]) + APART)
        spans, items, near = [[] for _ in range(size)], [set() for _ in range(size)], [set() for _ in range(size)]
        if len(searcher.keys):
            v, s = searcher.exact()
            step = np.zeros(searcher.room + 1, np.int64)
            np.add.at(step, s, 1)
            np.add.at(step, s + b.size[v], -1)
            inside = np.concatenate([[False], np.cumsum(step) > 0, [False]])
            first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            for x, y, d in zip(first.tolist(), last.tolist(), (np.searchsorted(base, first, "right") - 1).tolist(), strict=True):
                spans[d].append({"start": x - int(base[d]), "stop": y - int(base[d])})
            pair = np.unique(np.stack([np.searchsorted(base, s, "right") - 1, v], 1), axis=0) if len(v) else np.zeros((0, 2), int)
            for d, x in pair.tolist():
                items[d].update(b.names[k] for k in b.items[b.item_cut[x] : b.item_cut[x + 1]])
            v, s = searcher.near(v, s)
            owner = np.searchsorted(base, s + WINDOW - 1, "right") - 1
            for x, at, d in zip(v.tolist(), (s - base[owner]).tolist(), owner.tolist(), strict=True):
                span = max(0, at), min(int(n_words[d]), at + int(b.size[x]))
                near[d].update((b.names[k], *span) for k in b.items[b.item_cut[x] : b.item_cut[x + 1]])
        named = [[{"item": x, "start": y, "stop": z} for x, y, z in sorted(own)] for own in near]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array(spans, pa.list_(_SPAN)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(named, pa.list_(_NEAR))],
            ["row", "doc_id", "n_words", "spans", "items", "near"],
        )

    def run(batches):
        searcher = Searcher(shared.value)
        for batch in batches:
            held = batch.column("places").offsets.to_numpy()
            a = 0
            while a < batch.num_rows:  # a longer text is a step of its own
                b = max(a + 1, int(np.searchsorted(held, held[a] + (1 << 20), "right")) - 1)
                yield some(batch.slice(a, b - a), searcher)
                a = b

    return postings.mapInArrow(run, _FOUND.format(kind=postings.schema["doc_id"].dataType.simpleString()))


def vocabulary(found: DataFrame) -> np.ndarray | None:
    """The benchmark's different words, if they are MOST_TERMS at most."""
    words = found.select(F.explode("w").alias("h")).distinct().limit(MOST_TERMS + 1).toArrow()["h"].to_numpy()
    return np.sort(words.view(np.uint64)) if len(words) <= MOST_TERMS else None


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text): row, doc_id, n_words, n_hit, items, contaminated, spans, near."""
    prepare(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = scratch(windows(benchmark), "windows")
    postings = scratch(index(docs, vocabulary(cut)), "postings")
    found = None
    for block in blocks(cut):
        part = scratch(search(postings, block), "found")
        found = part if found is None else found.unionByName(part)
        several = found is not part
    if found is None:
        found, several = search(postings, _block([])), False
    else:
        discard(postings)
        discard(cut)
    if several:
        every = lambda c: F.flatten(F.collect_list(c))
        found = found.groupBy("row").agg(
            F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(every("spans")).alias("spans"), F.array_sort(F.array_distinct(every("items"))).alias("items"), F.array_sort(F.array_distinct(every("near"))).alias("near")
        )
    # Words of the sorted spans, none counted twice.
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")), lambda a: a["n"],
    )
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM iw, unnest(range(1, greatest(len(w) - 11, 2))) t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM dw, size, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
occ AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id),
post AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM dw),
often AS (SELECT term, count(*) AS c FROM post GROUP BY term),
v AS (SELECT n, g, unnest(string_split(g, ' ')) AS term, unnest(range(0, n)) AS o FROM (SELECT DISTINCT n, g FROM win)),
ranked AS (SELECT v.*, row_number() OVER (PARTITION BY g ORDER BY coalesce(c, 0), o) AS rare FROM v LEFT JOIN often USING (term)),
cand AS (SELECT DISTINCT n, g, doc_id, pos - o AS s FROM ranked JOIN post USING (term) WHERE rare <= 1 + n - CAST(ceil(0.8 * n - 1e-9) AS INT)),
close AS (
  SELECT n, g, doc_id, s FROM (SELECT DISTINCT c.n, c.g, c.doc_id, c.s, v.o FROM cand c JOIN v ON v.g = c.g JOIN post p ON p.doc_id = c.doc_id AND p.term = v.term AND abs(p.pos - c.s - v.o) <= 2)
  GROUP BY ALL HAVING count(*) >= ceil(0.8 * n - 1e-9)
), apart AS (
  SELECT * FROM close c WHERE NOT EXISTS (SELECT 1 FROM grams e WHERE e.doc_id = c.doc_id AND e.g = c.g AND e.n = c.n AND abs(e.i - c.s) <= 2)
), heads AS (
  SELECT *, lag(s) OVER (PARTITION BY doc_id, g ORDER BY s) AS before FROM apart
), near AS (
  SELECT doc_id, count(*) AS n_near FROM (
    SELECT DISTINCT h.doc_id, item_id, greatest(h.s, 1), least(len(dw.w) + 1, h.s + h.n) FROM heads h JOIN win USING (n, g) JOIN dw ON dw.doc_id = h.doc_id
    WHERE item_id IS NOT NULL AND (before IS NULL OR s - before > 2)
  ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
