"""Detection, numbering, rendering, map and restoring: a document is worked on whole, in one narrow step.

One implementation finds everything: `Finder` joins the texts of a batch with line breaks, which no pattern crosses,
and runs each detector once over all lines that hold any sign of a value; a value is blotted out with stand-ins before
the next detector, so the order of detectors is precedence and no one sees the inside of another's value. Known
addresses and persons follow, these in the whole texts.
Numbers are given per document and type by first place. Nothing is shuffled, and no text leaves its row: `redacted`
has one row for each row of its input, with the text and the entities of that row.

Rows are independent: rows of the same doc_id, or without one, are numbered each by itself. Null texts stay null and
have no entities, empty texts stay empty. A tag that stood in a text is itself an entity (type TAG), so that restoring
brings it back. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zastera.functions.detectors import CHECKS, DETECTORS, KEEP, MASKED, MASKS, OPTIONAL, SECRET_TYPES, SIGN_WORDS, SIGNS, Detector, rank
from zastera.functions.names import Library

from .common import on_path
from .people import People

TAG = r"\[\[[A-ZÀ-Ž_]+_[0-9]+\]\]"
_TAG = Detector("tag", "TAG", "", TAG, anchors=("[[",), confidence=1.0)
#: Shorter addresses are not looked for again.
LONG_ADDRESS = 15


class Config(NamedTuple):
    """What to look for and how to name it.

    types: these only (else all but OPTIONAL ones, and those of extra). whitelist: values left alone; blacklist: (type,
    value) always taken. min_confidence: what is less sure stays and becomes a warning. longest: of overlapping finds
    the longest wins, and then precedence; else precedence alone. surnames: surnames that stand alone behind pan or
    paní, or before a verb, are persons too. keep_initials: `J. N.` stays.
    """

    types: tuple[str, ...] | None = None
    extra: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[tuple[str, str], ...] = ()
    rename: dict[str, str] = {}
    show_secrets: bool = False
    min_confidence: float = 0.0
    longest: bool = False
    surnames: bool = False
    keep_initials: bool = False

    def wants(self, type_: str) -> bool:
        return type_ == "TAG" or (type_ in self.types if self.types is not None else type_ not in OPTIONAL or type_ in self.extra)


class Hit(NamedTuple):
    start: int
    stop: int
    type: str
    key: object  # hits of one type and key are one entity
    original: str
    confidence: float


def blotted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with stand-ins in some spans, which come in order."""
    parts, end = [], 0
    for a, b in spans:
        parts += [text[end:a], "\ue000" * (b - a)]
        end = b
    return "".join([*parts, text[end:]])


class Finder:
    """The hits of texts, a batch at a time."""

    def __init__(self, config: Config, detectors: Iterable[Detector], library: Library | None):
        detectors = tuple(detectors)
        forced = [Detector(f"forced_{k}", t, "", re.escape(v), case=True, confidence=1.0) for k, (t, v) in enumerate(config.blacklist)]
        wanted = [d if config.wants(d.type) else d._replace(type=KEEP) for d in [_TAG, *detectors] if config.wants(d.type) or d.type == KEEP or d.guard]
        self.passes = [(d, d.compiled()) for d in [*forced, *wanted]]
        self.masks = [(d, d.compiled()) for d in MASKS]
        self.config, self.white = config, frozenset(config.whitelist)
        # What is taken in any case, and detectors of others, may have no sign.
        self.every_line = bool(forced) or any(d not in DETECTORS for d in detectors)
        self.people = People(library or Library(), config) if config.wants("PERSON") else None

    def find(self, texts: list[str]) -> list[tuple[list[Hit], list[Hit], list[tuple[int, int, str]]]]:
        """For each text its hits in order, what was found but not sure enough, and masks (start, stop, what is put there)."""
        cuts = [0]
        for t in texts:
            cuts.append(cuts[-1] + len(t) + 1)
        whole = "\n".join(texts)
        lines, here, there = self._lines(whole)  # a place in lines is one in whole, moved by its line's difference
        free = lines  # with stand-ins for what is taken
        low = lines.lower()
        hits: list[list[Hit]] = [[] for _ in texts]
        unsure: list[list[Hit]] = [[] for _ in texts]
        masks: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        taken_at: list[tuple[int, int]] = []  # of whole

        def place(a: int, b: int) -> tuple[int, int, int]:
            """The text that a span of lines lies in, and its span there."""
            k = bisect_right(here, a) - 1
            move = there[k] - here[k]
            doc = bisect_right(cuts, a + move) - 1
            return doc, a + move - cuts[doc], b + move - cuts[doc]

        found = self._longest(lines, low) if self.config.longest else ((d, self._matches(d, p, free)) for d, p in self.passes if not d.anchors or any(a in low for a in d.anchors))
        for d, spans in found:
            taken = []
            for a, b in spans:
                value = lines[a:b]
                if d.type == KEEP:
                    taken.append((a, b))
                    continue
                if value in self.white or not CHECKS[d.check](value):
                    continue
                doc, start, stop = place(a, b)
                hit = Hit(start, stop, d.type, value.strip(), value.strip(), d.confidence)
                if d.confidence < self.config.min_confidence:
                    unsure[doc].append(hit)
                else:
                    taken.append((a, b))
                    hits[doc].append(hit)
            if taken:
                free = blotted(free, taken)
                taken_at += taken
        for d, pattern in self.masks:
            if any(x in low for x in d.anchors):
                for m in pattern.finditer(free):
                    doc, start, stop = place(*m.span(2))
                    masks[doc].append((start, stop, MASKED[d.name]))
        blots: dict[int, list[tuple[int, int]]] = {}
        for a, b in taken_at:
            doc, start, stop = place(a, b)
            blots.setdefault(doc, []).append((start, stop))
        for doc, text in enumerate(texts):
            rest = blotted(text, sorted(blots[doc])) if doc in blots else text
            forms = self._address_forms({h.original for h in hits[doc] if h.type == "ADDRESS" and len(h.original) > LONG_ADDRESS})
            if forms:
                hits[doc] = [h._replace(key=forms.get(h.original, h.original), original=forms.get(h.original, h.original)) if h.type == "ADDRESS" else h for h in hits[doc]]
                pattern = "|".join(re.escape(x) for x in sorted(forms, key=lambda x: (-len(x), x)))
                more = [Hit(m.start(), m.end(), "ADDRESS", forms[m[0]], forms[m[0]], 0.9) for m in re.finditer(pattern, rest)]
                hits[doc] += more
                rest = blotted(rest, [(h.start, h.stop) for h in more])
            for p in self.people.find(rest) if self.people else ():
                if p.surface in self.white or p.original in self.white:
                    continue
                sure = p.confidence >= self.config.min_confidence or p.type != "PERSON"
                (hits if sure else unsure)[doc].append(Hit(p.start, p.stop, p.type, p.key, p.original, p.confidence))
        first = lambda x: x[:2]
        return [(sorted(h, key=first), sorted(u, key=first), sorted(m)) for h, u, m in zip(hits, unsure, masks, strict=True)]

    def _lines(self, whole: str) -> tuple[str, list[int], list[int]]:
        """The lines in which a detector may find something, joined; where each begins there, and in whole."""
        low = whole.lower()
        words = [w for w in SIGN_WORDS if w in low]
        sign = re.compile("|".join([SIGNS.pattern, *map(re.escape, words)]), re.I) if words else SIGNS
        lines, here, there, at, size = [], [], [], 0, 0
        for line in whole.split("\n"):
            if self.every_line or sign.search(line):
                lines.append(line)
                here.append(size)
                there.append(at)
                size += len(line) + 1
            at += len(line) + 1
        return "\n".join(lines), here, there

    @staticmethod
    def _matches(d: Detector, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
        for m in pattern.finditer(text):
            if m.start(2) < m.end(2):
                yield m.span(2)

    def _longest(self, text: str, low: str) -> Iterator[tuple[Detector, list[tuple[int, int]]]]:
        """The detectors' finds without overlaps: the longest first, then by precedence of types, then by order."""
        every = []
        for k, (d, pattern) in enumerate(self.passes):
            if not d.anchors or any(a in low for a in d.anchors):
                every += [(a - b, 0 if d.type in ("TAG", KEEP) else 1 + rank(d.type), k, a, b) for a, b in self._matches(d, pattern, text) if CHECKS[d.check](text[a:b])]
        taken: list[tuple[int, int]] = []  # sorted, without overlaps
        kept: dict[int, list[tuple[int, int]]] = {}
        for _, _, k, a, b in sorted(every):
            i = bisect_right(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                taken.insert(i, (a, b))
                kept.setdefault(k, []).append((a, b))
        for k in sorted(kept):
            yield self.passes[k][0], sorted(kept[k])

    @staticmethod
    def _address_forms(known: set[str]) -> dict[str, str]:
        """The addresses of a text, and those without their postcode, by what each stands for."""
        short = {x: re.sub(r", [0-9]{3} ?[0-9]{2} ", ", ", x) for x in sorted(known)}
        return {x: x for x in known} | {s: x for x, s in short.items() if s != x and len(s) > LONG_ADDRESS}


_ENTITY = [("type", pa.string()), ("idx", pa.int64()), ("label", pa.string()), ("original", pa.string()), ("occurrences", pa.int64()), ("variants", pa.list_(pa.string())), ("confidence", pa.float64())]
_WARNING = [("type", pa.string()), ("value", pa.string()), ("confidence", pa.float64())]
_SCHEMA = "doc_id {kind}, text string, entities array<struct<type: string, idx: long, label: string, original: string, occurrences: long, variants: array<string>, confidence: double>>, warnings array<struct<type: string, value: string, confidence: double>>"


def rendered(text: str, hits: list[Hit], masks: list[tuple[int, int, str]], rename: dict[str, str]) -> tuple[str, list[dict]]:
    """The text with tags and masks, and its entities by type and number."""
    entities: dict[tuple[str, object], dict] = {}
    count: dict[str, int] = {}
    put: list[tuple[int, int, str]] = list(masks)
    for h in hits:
        type_ = rename.get(h.type, h.type)
        e = entities.get((type_, h.key))
        if e is None:
            n = count[type_] = count.get(type_, 0) + 1
            e = entities[type_, h.key] = {"type": type_, "idx": n, "label": f"[[{type_}_{n}]]", "original": h.original, "occurrences": 0, "variants": set(), "confidence": h.confidence}
        e["occurrences"] += 1
        e["variants"].add(text[h.start : h.stop].strip())
        e["confidence"] = max(e["confidence"], h.confidence)
        put.append((h.start, h.stop, e["label"]))
    parts, end = [], 0
    for a, b, with_ in sorted(put):
        if a >= end:
            parts += [text[end:a], with_]
            end = b
    out = "".join([*parts, text[end:]]) if put else text
    return out, sorted(({**e, "variants": sorted(e["variants"])} for e in entities.values()), key=lambda e: (e["type"], e["idx"]))


def redacted(docs: DataFrame, config: Config = Config(), detectors: Iterable[Detector] = tuple(DETECTORS), names: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """(doc_id, text, entities, warnings) of every row of docs (doc_id, text). names: male and female first names, by default the short own list."""
    detectors = tuple(detectors)
    on_path(docs.sparkSession)

    def run(batches):
        finder = Finder(config, detectors, Library(*names) if names else None)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # at most a million characters at a time, or one text
                stop, held = at, 0
                while stop < len(texts) and (held < 1 << 20 or stop == at):
                    held += len(texts[stop] or "")
                    stop += 1
                some = texts[at:stop]
                out, entities, warnings = [], [], []
                for text, (hits, unsure, masks) in zip(some, finder.find([t or "" for t in some]), strict=True):
                    clear, own = rendered(text or "", hits, masks, config.rename)
                    out.append(None if text is None else clear)
                    entities.append(own)
                    warnings.append([{"type": config.rename.get(h.type, h.type), "value": h.original, "confidence": h.confidence} for h in unsure])
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array(out, pa.string()), pa.array(entities, pa.list_(pa.struct(_ENTITY))), pa.array(warnings, pa.list_(pa.struct(_WARNING)))], ["doc_id", "text", "entities", "warnings"])
                at = stop

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def known(done: DataFrame) -> DataFrame:
    """The replacement map of `redacted` rows: doc_id, type, idx, label, original, occurrences, variants, confidence."""
    return done.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


def redact(docs: DataFrame, config: Config = Config(), detectors: Iterable[Detector] = tuple(DETECTORS), names: tuple[list[str], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The redacted documents and the replacement map. Both come from `redacted`: store that first to work once."""
    done = redacted(docs, config, detectors, names)
    return done.select("doc_id", "text"), known(done)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_no, text) of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_no", "text"))


def valid(d: Detector, value: Column) -> Column:
    """A detector's check, for a column of values."""
    z = F.regexp_replace(value, "[^0-9]", "")
    if d.check == "luhn":
        return F.call_function("luhn_check", z) & F.length(z).between(13, 19)
    if d.check == "birth":
        return (F.length(z) == 9) | (z.cast("long") % 11 == 0)
    if d.check == "digit":
        return value.rlike("[0-9]")
    if d.check == "phone":
        return F.length(z).between(8, 15)
    return F.lit(True)


def shown(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """The map as it may be written: secrets as `***` and, for cards, the last four characters; their variants go."""
    secret = F.col("type").isin(*SECRET_TYPES, *(config.rename[t] for t in SECRET_TYPES if t in config.rename)) & F.lit(not config.show_secrets)
    card = F.col("type").isin("CARD", config.rename.get("CARD", "CARD"))
    blot = F.when(card, F.concat(F.lit("***"), F.right("original", F.lit(4)))).otherwise(F.lit("***"))
    rows = rows.withColumn("original", F.when(secret, blot).otherwise(F.col("original")))
    return rows.withColumn("variants", F.when(secret, F.array().cast("array<string>")).otherwise(F.col("variants"))) if "variants" in rows.columns else rows


def map_json(rows: DataFrame, generated_at: str | None = None, source_file: Column | None = None, notes: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, json): the entities of each document, ordered by type and number, with the header fields that are given."""
    entity = F.struct("type", "idx", F.struct("type", "label", "original", "occurrences").alias("e"))
    done = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(entity)).alias("x"))
    head = [F.lit("1.0").alias("version")]
    head += [F.lit(generated_at).alias("generated_at")] if generated_at else []
    head += [source_file.alias("source_file")] if source_file is not None else []
    tail = [F.array(*map(F.lit, notes)).alias("notes")] if notes else []
    return done.select("doc_id", F.to_json(F.struct(*head, F.transform("x", lambda x: x["e"]).alias("entities"), *tail)).alias("json"))


def map_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, type, idx, line): `TYPE → label : original (výskyty: n)`."""
    return rows.select("doc_id", "type", "idx", F.concat("type", F.lit(" → "), "label", F.lit(" : "), "original", F.lit(" (výskyty: "), F.col("occurrences").cast("string"), F.lit(")")).alias("line"))


def map_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): the map for people to read: persons first, with their variants, then a section for each type by name."""
    line = F.concat("label", F.lit(": "), "original", F.when((F.col("type") == "PERSON") & (F.size("variants") > 0), F.concat(F.lit(" ("), F.array_join("variants", ", "), F.lit(")"))).otherwise(F.lit("")), F.lit(", výskyty: "), F.col("occurrences").cast("string"))
    section = F.when(F.col("type") == "PERSON", F.lit("OSOBY")).otherwise(F.col("type"))
    per = rows.groupBy("doc_id", section.alias("section")).agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("x"))
    block = F.concat_ws("\n", F.col("section"), F.repeat(F.lit("-"), F.length("section")), F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    whole = per.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((F.col("section") != "OSOBY").alias("k"), "section", block.alias("block")))).alias("x"))
    return whole.select("doc_id", F.array_join(F.transform("x", lambda x: x["block"]), "\n\n").alias("text"))


def _restored(text: Column, labels: Column, originals: Column) -> Column:
    """A text with the original in place of each label; both lists are those of its map."""
    cut, tags = F.split(text, TAG, -1), F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    back = F.map_from_arrays(labels, originals)
    pieces = F.transform(cut, lambda x, i: F.concat(x, F.when(i < F.size(tags), F.coalesce(F.try_element_at(back, F.get(tags, i)), F.get(tags, i))).otherwise(F.lit(""))))
    return F.when((F.size(labels) > 0) & (F.size(tags) > 0), F.array_join(pieces, "")).otherwise(text)


def restored(done: DataFrame) -> DataFrame:
    """(doc_id, text) of `redacted` rows with the originals back; null texts stay null."""
    part = lambda c: F.transform("entities", lambda e: e[c])
    return done.select("doc_id", _restored(F.col("text"), part("label"), part("original")).alias("text"))


def restore(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the originals of a stored map, whose doc_ids are different; documents without a row, or a text, stay as they are."""
    per = rows.groupBy("doc_id").agg(F.collect_list("label").alias("labels"), F.collect_list("original").alias("originals"))
    none = F.array().cast("array<string>")
    return docs.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", _restored(F.col("text"), F.coalesce("labels", none), F.coalesce("originals", none)).alias("text"))

