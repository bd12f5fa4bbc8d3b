"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by scaled recursion.

Words are the runs between ASCII white space, A-Z lower-cased, and every text ends with one end token. The
SYMBOLS most frequent tokens are symbols of their own; any other word is emitted as one of CLASSES classes (by its
last two bytes) and then drawn from that class by its smoothed corpus count, so the model is a proper
distribution over texts.

Every count is over all training rows, none of which is sampled or cut. The states start from the corpus's counts,
each symbol leaning at random (but the same in every run) towards one of them, and from moves that seldom leave a state;
each of ROUNDS rounds is then one pass of forward-backward over all texts. A text longer than PIECE tokens is worked
on in pieces, whose transfer matrices carry the recursions over the cuts, so that the expected counts are those of
the whole text.

What goes to the driver and back to the workers is bounded by TOP, SYMBOLS, CLASSES and STATES. Counts of rarer words
stay in a table that is joined by hash. A word's identity is its 64-bit hash.

Null and empty texts are the end token alone. Repeated rows are trained on and scored each; null ids are ids like
others. With no training rows every count is 0, base_score is that of N = V = 0 (log10 1 = 0 a token), and the model is
uniform over the classes. No rows to score give no rows. Only doc_id, text and held_out are read, whatever other
columns are called.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, prepare, scratch

STATES, SYMBOLS, TOP, CLASSES = 8, 65_536, 262_144, 256
ROUNDS, PIECE, STEP, LEAN, STAY = 3, 4096, 1 << 18, 0.4, 0.99
END = np.uint64(0xE0D0C0B0A0908071)


class Model(NamedTuple):
    """Frequent words' hashes and counts (the first SYMBOLS are symbols), and the parameters of the chain."""

    hashes: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    start: np.ndarray  # of a text
    move: np.ndarray
    emit: np.ndarray  # symbols and classes x states

    @property
    def symbols(self) -> int:
        return len(self.emit) - CLASSES


def _tokens(column: pa.Array):
    """For each chunk: first row, end row, hashes with the ends put in, class of each, offsets."""
    for i, j, data, off in K.chunks(column):
        w = K.words(data, off, K.SPACED_LOWER)
        last = w.data[w.stop - 1].astype(np.int32)
        before = np.where(w.stop - w.start > 1, w.data[np.maximum(w.stop - 2, 0)], 0)
        kind = (last * 31 + before) % CLASSES
        yield i, j, np.insert(w.hash, w.off[1:], END), np.insert(kind, w.off[1:], -1).astype(np.int16), w.off + np.arange(len(w.off))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, kind, n) of every token of the column text; each task adds up before it sends."""

    def count(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged(parts):
            h, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at, back = np.unique(h, return_index=True, return_inverse=True)
            return keys, kind[at], np.bincount(back, n, len(keys)).astype(np.int64)

        def rows(parts):
            h, kind, n = merged(parts)
            for k in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (h.view(np.int64), kind, n)], ["h", "kind", "n"])

        for batch in batches:
            for _, _, h, kind, _ in _tokens(batch.column(0)):
                held.append((h, kind, np.ones(len(h), np.int64)))
                size += len(h)
            if size > 1 << 20:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return texts.select("text").mapInArrow(count, "h long, kind short, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words with a count of at least some n, chosen so that they are `most` at most; no sort, no tie cut in two."""
    level = F.floor(F.log2("n") * 32)
    left = most
    cut = 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        cut = r["level"]
    return counts.filter(level >= cut)


class Reader:
    """Symbols of hashes: places among the frequent words, classes for the others."""

    def __init__(self, hashes: np.ndarray, symbols: int):
        self.index, self.symbols = K.HashIndex(hashes), symbols

    def __call__(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.index.find(h)
        own = (place >= 0) & (place < self.symbols)
        return place, np.where(own, place, self.symbols + np.maximum(kind, 0).astype(np.int32))


def _pieces(off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text cut into pieces of at most `most` tokens: text, start, length, whether it is the text's first."""
    size = np.diff(off)
    n = -(-size // most)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return doc, off[doc] + k * most, np.minimum(most, size[doc] - k * most), k == 0


def _ends(sym: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its first row, and rows of (shares of the states after its last token, log of their sum).

    A text's first piece has one row, from the start; a later one has a row from each state before it.
    """
    row = np.repeat(np.arange(len(start)), np.where(first, 1, STATES))
    state = np.arange(len(row)) - np.searchsorted(row, row)
    a = np.where(first[row][:, None], m.start, m.move[state])
    order = np.argsort(-size[row], kind="stable")
    n, s, a = size[row][order], start[row][order], a[order]
    logs = np.zeros(len(row))
    alive = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), "right")
    for t, k in enumerate(alive):
        head = a[:k]
        head[...] = (head @ m.move if t else head) * m.emit[sym[s[:k] + t]]
        if t % 8 == 7:
            c = head.sum(1)
            head /= c[:, None]
            logs[:k] += np.log(c)
    if len(row):
        c = a.sum(1)
        a /= c[:, None]
        logs += np.log(c)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return np.searchsorted(row, np.arange(len(start))), a[back], logs[back]


def _through(v: np.ndarray, a: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the states after a piece, given those before it, and the log of the piece's probability."""
    w = (v * np.exp(logs - logs.max())) @ a
    return w / w.sum(), float(logs.max() + np.log(w.sum()))


def _borders(sym: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the shares of the states before it (of a later piece) and the weights of the states at its end."""
    before, after = np.zeros((len(doc), STATES)), np.ones((len(doc), STATES))
    cut = np.flatnonzero(np.isin(doc, doc[~first]))
    if len(cut):
        at, a, logs = _ends(sym, start[cut], size[cut], first[cut], m)
        v = b = m.start
        for k, p in enumerate(cut.tolist()):
            if first[p]:
                v = a[at[k]]
                continue
            before[p] = v
            v = _through(v, a[at[k] : at[k] + STATES], logs[at[k] : at[k] + STATES])[0]
        for k, p in zip(range(len(cut) - 1, -1, -1), cut[::-1].tolist(), strict=True):
            if p + 1 < len(doc) and doc[p + 1] == doc[p]:
                after[p] = b
            if not first[p]:
                own = logs[at[k] : at[k] + STATES]
                b = np.exp(own - own.max()) * (a[at[k] : at[k] + STATES] @ after[p])
                b = b / b.max()
    return before, after


def expected(sym: np.ndarray, off: np.ndarray, m: Model, into: dict) -> None:
    """Adds the expected counts of a forward-backward pass over whole texts to `into`, STEP tokens in memory at a time."""
    doc, start, size, first = _pieces(off, PIECE)
    before, after = _borders(sym, doc, start, size, first, m)
    held = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + STEP, "right")))
        _forward_backward(sym, start[at:stop], size[at:stop], first[at:stop], before[at:stop], after[at:stop], m, into)
        at = stop


def _forward_backward(sym, start, size, first, before, after, m: Model, into: dict) -> None:
    order = np.argsort(-size, kind="stable")
    s, n, f, before, b_end = start[order], size[order], first[order], before[order], after[order]
    alive = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0])), "right")
    base = np.concatenate([[0], np.cumsum(alive)])
    t_of = np.repeat(np.arange(len(alive)), alive)
    ids = sym[s[np.arange(base[-1]) - base[t_of]] + t_of]  # all first tokens, all second ones, and so on
    emits = m.emit[ids]
    alpha, scale = np.empty_like(emits), np.empty((len(ids), 1))
    a = np.where(f[:, None], m.start, before @ m.move)
    for t, k in enumerate(alive.tolist()):
        here = slice(base[t], base[t] + k)
        a = (a[:k] @ m.move if t else a) * emits[here]
        c = a.sum(1, keepdims=True)
        a /= c
        alpha[here], scale[here] = a, c
    into["log"] += float(np.log(scale).sum())
    emits /= scale
    move = np.zeros((STATES, STATES))
    b = np.zeros((0, STATES))
    for t in range(len(alive) - 1, -1, -1):
        k = int(alive[t])
        here = slice(base[t], base[t] + k)
        if k > len(b):  # pieces that end here
            ends = b_end[len(b) : k]
            ends = ends / (alpha[base[t] + len(b) : base[t] + k] * ends).sum(1, keepdims=True)
            b = np.concatenate([b, ends])
        eb = emits[here] * b
        alpha[here] *= b
        move += alpha[base[t - 1] : base[t - 1] + k].T @ eb if t else before.T @ eb
        b = eb @ m.move.T
    into["move"] += m.move * move
    into["start"] += alpha[: len(n)][f].sum(0)
    for k in range(STATES):
        into["emit"][:, k] += np.bincount(ids, alpha[:, k], len(m.emit))


def _empty(m: Model) -> dict:
    return {"start": np.zeros(STATES), "move": np.zeros((STATES, STATES)), "emit": np.zeros(m.emit.shape), "log": 0.0}


def maximised(m: Model, got: dict, base: np.ndarray) -> Model:
    """base: each symbol's share of the corpus, towards which a state's emissions are smoothed."""
    emit = got["emit"] + 500.0 * base[:, None]
    move, start = got["move"] + 1.0, got["start"] + 0.1
    return m._replace(start=start / start.sum(), move=move / move.sum(1, keepdims=True), emit=emit / emit.sum(0))


def encoded(texts: DataFrame, shared, symbols: int) -> DataFrame:
    """The symbols of each text, as 32-bit integers, so that rounds needn't read words again."""

    def run(batches):
        read = Reader(shared.value.hashes, symbols)
        for batch in batches:
            out: list[bytes] = []
            for _, _, h, kind, off in _tokens(batch.column(0)):
                sym = read(h, kind)[1].astype("<i4")
                out += [sym[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["symbols"])

    return texts.select("text").mapInArrow(run, "symbols binary")


def e_step(rows: DataFrame, shared, symbols: int) -> dict:
    """The expected counts of all encoded texts: each task adds up its own and sends at most symbols + classes + a few rows."""
    at = symbols + CLASSES

    def run(batches):
        m = shared.value
        into = _empty(m)
        for batch in batches:
            column = batch.column(0)
            cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            sym = np.frombuffer(column.buffers()[2], "<i4") if len(cut) > 1 else np.zeros(0, "<i4")
            off = cut.astype(np.int64) // 4
            first = 0
            while first < len(column):
                stop = max(first + 1, int(np.searchsorted(off, off[first] + STEP, "right")) - 1)
                expected(sym[off[first] : off[stop]], off[first : stop + 1] - off[first], m, into)
                first = stop
        log = np.full((1, STATES), into["log"] / STATES)
        rows = np.concatenate([into["emit"], into["move"], into["start"][None], log])
        ids = np.flatnonzero((rows != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(rows[ids, k].astype(np.float32)) for k in range(STATES))], ["k", *(f"s{k}" for k in range(STATES))])

    schema = "k int, " + ", ".join(f"s{k} float" for k in range(STATES))
    rows = rows.mapInArrow(run, schema).groupBy("k").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).toArrow()
    out = np.zeros((at + STATES + 2, STATES))
    out[rows["k"].to_numpy()] = np.stack([rows[f"s{k}"].to_numpy() for k in range(STATES)], 1)
    return {"emit": out[:at], "move": out[at : at + STATES], "start": out[at + STATES], "log": out[at + STATES + 1].sum()}


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the table (h, kind, n) of all training tokens. texts: doc_id, text."""
    spark = texts.sparkSession
    prepare(spark)
    counts = scratch(count_tokens(texts), "counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, TOP).toArrow()
    hashes, amount, kinds = (top[x].to_numpy() for x in ("h", "n", "kind"))
    order = np.lexsort((hashes, -amount))
    hashes, amount, kinds = hashes.view(np.uint64)[order], amount[order], kinds[order]
    symbols = min(SYMBOLS, len(hashes))
    if symbols and END not in hashes[:symbols]:  # rarer than SYMBOLS words: texts of extreme length
        at = int(np.flatnonzero(hashes == END)[0]) if END in hashes else len(hashes) - 1
        if hashes[at] != END:
            hashes[at], amount[at] = END, counts.filter(F.col("h") == int(END.view(np.int64))).first()["n"]
        for x in (hashes, amount, kinds):
            x[[symbols - 1, at]] = x[[at, symbols - 1]]
    own = F.broadcast(spark.createDataFrame(pa.table({"h": hashes[:symbols].view(np.int64)}))) if symbols else None
    rest = counts if own is None else counts.join(own, "h", "left_anti")
    by_kind = {r["kind"]: r["n"] for r in rest.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    base = np.concatenate([amount[:symbols].astype(float), [float(by_kind.get(k, 0)) for k in range(CLASSES)]]) + 0.5
    base /= base.sum()
    lean = np.random.Generator(np.random.PCG64(7)).integers(0, STATES, len(base))
    emit = base[:, None] * np.where(lean[:, None] == np.arange(STATES), LEAN, (1 - LEAN) / (STATES - 1))
    move = np.full((STATES, STATES), (1 - STAY) / STATES) + STAY * np.eye(STATES)
    m = Model(hashes, amount, int(totals["n"]), int(totals["v"]), np.full(STATES, 1 / STATES), move, emit / emit.sum(0))
    if not totals["n"]:
        return m, counts
    rows = scratch(encoded(texts, spark.sparkContext.broadcast(m), symbols), "symbols") if rounds else None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(m)
        m = maximised(m, e_step(rows, shared, symbols), base)
        shared.unpersist()
    if rows is not None:
        discard(rows)
    return m, counts


def log_likelihood(sym: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    """Natural log of the exact probability of each symbol sequence.

    A text longer than PIECE is cut; a later piece is run once from each state, and the pieces' matrices are
    multiplied, which gives the same sum over all state paths.
    """
    doc, start, size, first = _pieces(off, PIECE)
    at, a, logs = _ends(sym, start, size, first, m)
    out = np.zeros(len(off) - 1)
    out[doc[first]] = logs[at[first]]
    v: np.ndarray = m.start
    for p in np.flatnonzero(np.isin(doc, doc[~first])):
        if first[p]:
            v = a[at[p]]
            continue
        v, more = _through(v, a[at[p] : at[p] + STATES], logs[at[p] : at[p] + STATES])
        out[doc[p]] += more
    return out


def score(docs: DataFrame, m: Model, counts: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out; one row for each: n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    shared, n_all, v_all = spark.sparkContext.broadcast(m), m.n, m.v
    floor = float(n_all + 0.5 * (v_all + 1))

    def run(batches):
        m = shared.value
        read = Reader(m.hashes, m.symbols)
        log_count = np.log10((m.counts + 0.5) / floor)
        for batch in batches:
            parts = []
            for _, _, h, kind, off in _tokens(batch.column(1)):
                place, sym = read(h, kind)
                rare = np.flatnonzero(place < 0)
                near = np.flatnonzero(place >= m.symbols)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                size = len(off) - 1
                base = np.bincount(doc, np.where(place >= 0, log_count[place] if len(log_count) else 0.0, 0.0), size)
                known = np.bincount(doc[place >= 0], minlength=size)
                parts.append((sym, off, base, known, h, kind, near, rare, doc, place))
            sym = np.concatenate([x[0] for x in parts])
            off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in parts]))])
            chain = log_likelihood(sym, off, m) / np.log(10) if len(m.counts) else np.diff(off) * np.log10(1 / CLASSES)
            cut = [0]
            hash_, kind_, count_ = [], [], []
            for _, o, _, _, h, kind, near, rare, doc, place in parts:
                far = np.concatenate([near, rare])  # emitted by class: their count in the class is looked up
                far = far[np.argsort(doc[far], kind="stable")]
                hash_.append(h[far].view(np.int64))
                kind_.append(np.maximum(kind[far], 0))
                count_.append(np.where(place[far] >= 0, m.counts[place[far]] if len(m.counts) else 0, -1))
                cut.extend(cut[-1] + np.cumsum(np.bincount(doc[far], minlength=len(o) - 1)))
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (hash_, [k.astype(np.int16) for k in kind_], [c.astype(np.int64) for c in count_])], ["h", "kind", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(off)), pa.array(np.concatenate([x[3] for x in parts]).astype(np.int64)), pa.array(np.concatenate([x[2] for x in parts])), pa.array(chain), pa.ListArray.from_arrays(pa.array(np.array(cut), pa.int32()), items)],
                ["doc_id", "held_out", "n_tokens", "known", "base", "chain", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, chain double, rare array<struct<h: long, kind: short, n: long>>")
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    symbols = spark.createDataFrame(pa.table({"h": m.hashes[: m.symbols].view(np.int64)})) if m.symbols else None
    classes = (counts if symbols is None else counts.join(F.broadcast(symbols), "h", "left_anti")).groupBy("kind").agg(F.sum("n").alias("kind_n"), F.count("*").alias("kind_v"))
    far = rows.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.kind", "x.n")
    near = far.filter("n >= 0").select("row", "kind", F.col("n").alias("n"), F.lit(False).alias("looked"), F.lit(1).alias("times"))
    # A word that is not among the TOP: its occurrences are added up before they meet its count.
    far = far.filter("n < 0").groupBy("row", "h", "kind").agg(F.count("*").cast("int").alias("times"))
    found = far.join(counts.select("h", "n"), "h", "left").select("row", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("looked"), "times")
    sums = (
        near.unionByName(found).join(F.broadcast(classes), "kind", "left").groupBy("row").agg(
            F.sum(F.when(F.col("looked"), F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(floor))).otherwise(0.0)).alias("base_far"),
            F.sum(F.when(F.col("looked") & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("known_far"),
            F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / (F.coalesce("kind_n", F.lit(0)) + 0.5 * (F.coalesce("kind_v", F.lit(0)) + 1)))).alias("in_class"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("known_far")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_far")).alias("base_score"), (F.col("chain") + zero("in_class")).alias("score"),
    )
