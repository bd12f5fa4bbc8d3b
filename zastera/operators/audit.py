"""Audit of redacted documents against their map: findings, score, verdict and report.

Rules follow the audit's specification: hard fails cost 3.0 each and none is allowed, majors 1.0, minors 0.3 or 0.5, and
up to two bonuses of 0.3 add 0.5 at most. `plain` is the end scan: strong detectors run again over what stands outside
tags, in one pass over the texts. Null texts have no findings. doc_ids have to be different for the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zastera.functions.detectors import BY_NAME
from zastera.functions.names import Library, agreeing

from .common import on_path
from .redact import TAG, valid

# Penalties, bonuses, the pass mark, and what may not be left in clear.
HARD, MAJOR, MINOR, SMALL, BONUS, MOST_BONUS, PASS = 3.0, 1.0, 0.5, 0.3, 0.3, 0.5, 9.3
HARD_DETECTORS = ("card_bare", "card", "password", "credentials_password", "api_key", "secret", "ssh_key", "hex_token", "iban", "birth_id", "birth_id_context", "email")
#: The optional ones.
STRICT_DETECTORS = (*HARD_DETECTORS, "ipv4", "host")
SECTIONS = {"hard": "Hard fails", "major": "Majors", "minor": "Minors"}


def tags(docs: DataFrame) -> DataFrame:
    """(doc_id, label, n) of the tags in the texts."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(0))).alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def plain(docs: DataFrame, names: tuple[str, ...] = HARD_DETECTORS) -> DataFrame:
    """(doc_id, rule, evidence): the different values that detectors still find outside tags."""
    text = F.regexp_replace("text", TAG, "\n")

    def hits(name: str) -> Column:
        d = BY_NAME[name]
        every = F.regexp_extract_all(text, F.lit(d.java), F.lit(2))
        every = F.filter(every, lambda x: valid(d, x)) if d.check else every
        return F.transform(every, lambda x: F.struct(F.lit(f"plain_{d.type.lower()}").alias("rule"), x.alias("evidence")))

    # Most texts hold no sign of a value; the pattern of signs is one quick look.
    rows = docs.filter(F.col("text").rlike(r"[0-9@:=]|ssh-|ecdsa-")) if set(names) <= set(STRICT_DETECTORS) else docs.filter("text IS NOT NULL")
    return rows.select("doc_id", F.explode(F.array_distinct(F.concat(*map(hits, names)))).alias("x")).select("doc_id", "x.*")


def _texts(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(doc_id, rule, evidence) of every place that a rule's pattern finds."""

    def hits(rule: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("evidence")))

    return docs.filter(F.col("text").rlike(r"[0-9\]:]")).select("doc_id", F.explode(F.concat(*(hits(*r) for r in rules.items()))).alias("x")).select("doc_id", "x.*")


# Patterns of wrong types, of redaction left undone, and of untidy texts.
HARD_TEXT = {"id_card_as_phone": r"(?iu)(?<!\p{L})(?:OP|pas|občanský průkaz|č\. pasu)\s*:?\s*\[\[PHONE_\d+\]\]"}
MAJOR_TEXT = {
    "bank_in_case_number": r"(?iu)(?<!\p{L})(?:FÚ|KS|VS|čj)\s?-?\s?\[\[BANK_\d+\]\]",
    "phone_in_technical_token": r"(?:IRIS|VOICE|HASH_BIO|DB_GENOME)_\w*\[\[PHONE_\d+\]\]",
    "card_check_value": r"(?iu)cv[vc]2?\s*:?\s*\d{3,4}(?!\d)",
    "card_expiry": r"(?iu)(?:exp|expirace|platnost)\.?\s*:?\s*\d{2}/\d{2,4}",
}
MINOR_TEXT = {
    "birth_date_in_clear": r"(?iu)(?<!\p{L})(?:nar\.|narozen[áaý]?|datum narození)\s*:?\s*\d{1,2}[./-]\s?\d{1,2}[./-]\s?\d{4}",
    "glued_tag": r"\]\]\p{L}\w*|\d\[\[(?:BANK|BIRTH_ID|IBAN|PHONE)_\d+\]\]",
    "stray_sign": r"(?<=\S)\.:",
}


@F.pandas_udf(T.BooleanType())
def _nominative(x):
    """Whether a person's name stands in the nominative, as far as the short library knows its first name."""
    library = Library()

    def one(name: str) -> bool:
        words = name.split(" ")
        if len(words) < 2 or words[0] not in library:
            return True
        found = agreeing(words[0], words[-1], library)
        return not found or any((a, b) == (words[0], words[-1]) for a, b, _, _ in found)

    return x.map(one, na_action="ignore")


def findings(docs: DataFrame, known: DataFrame, test_mode: bool = False, names: tuple[str, ...] = HARD_DETECTORS) -> DataFrame:
    """(doc_id, rule, severity, penalty, evidence). test_mode: the map has to hold whole values."""
    on_path(docs.sparkSession)
    used = tags(docs)
    rule = lambda rows, name, evidence: rows.select("doc_id", F.lit(name).alias("rule"), evidence.alias("evidence"))
    label, original = F.col("label"), F.col("original")

    def union(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    empty = known.filter("original IS NULL OR trim(original) = ''")
    amounts = known.filter((F.col("type") == "AMOUNT") & original.rlike(r"^(?:\+420|00420)?\s?\d{3}\s\d{3}\s\d{3}$"))
    hard = union(plain(docs, names), _texts(docs, HARD_TEXT), rule(used.join(known, ["doc_id", "label"], "left_anti"), "tag_not_in_map", label), rule(empty, "map_value_empty", label), rule(amounts, "phone_as_amount", label))
    if test_mode:
        hard = hard.unionByName(rule(known.filter(original.startswith("***")), "map_value_redacted", label))
    cards = known.filter((F.col("type") == "CARD") & original.rlike(r"^[A-Z]{2}\d{2}"))
    merged = known.filter((F.col("type") == "PERSON") & (F.size(F.split("original", " ")) > 1) & original.rlike(r"[,;/]| a "))
    major = union(_texts(docs, MAJOR_TEXT), rule(known.join(used, ["doc_id", "label"], "left_anti"), "map_row_unused", label), rule(cards, "iban_as_card", label), rule(merged, "two_persons_in_one", label))
    prefix = known.filter((F.col("type") == "ADDRESS") & original.rlike(r"(?iu)^(?:trvale bytem|bytem|bydliště|se sídlem|sídlo|adresa|místo podnikání)"))
    oblique = known.filter((F.col("type") == "PERSON") & ~_nominative("original"))
    small = union(_texts(docs, MINOR_TEXT), rule(prefix, "address_prefix", label))
    with_ = lambda rows, s, p: rows.select("doc_id", "rule", F.lit(s).alias("severity"), F.lit(p).alias("penalty"), "evidence")
    return union(with_(hard, "hard", HARD), with_(major, "major", MAJOR), with_(small, "minor", SMALL), with_(rule(oblique, "person_not_nominative", label), "minor", MINOR))


def score(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, hard, major, minor, penalty, bonus, score, verdict) of every document.

    Bonuses: nothing left for the end scan; no value of a wrong type; persons all in the nominative.
    """
    count = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s)
    any_ = lambda c: F.max(c.cast("int"))
    name = F.col("rule")
    sums = found.groupBy("doc_id").agg(
        count("hard"), count("major"), count("minor"), F.sum("penalty").alias("penalty"),
        any_(name.startswith("plain_")).alias("left"), any_(name.isin("id_card_as_phone", "phone_as_amount", "iban_as_card", *MAJOR_TEXT)).alias("wrong"), any_(name == "person_not_nominative").alias("oblique"),
    )
    rows = docs.select("doc_id").distinct().join(sums, "doc_id", "left").fillna(0)
    earned = 3 - F.col("left") - F.col("wrong") - F.col("oblique")
    rows = rows.withColumn("bonus", F.least(F.lit(MOST_BONUS), BONUS * F.least(F.lit(2), earned)))
    rows = rows.withColumn("score", F.round(10 - F.col("penalty") + F.col("bonus"), 1))
    verdict = F.when((F.col("score") >= PASS) & (F.col("hard") == 0), "GO").otherwise("NO-GO")
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("hard", "major", "minor")), F.round("penalty", 1).alias("penalty"), "bonus", "score", verdict.alias("verdict"))


# Fixed value: what a pipeline should check in every run.
CHECKLIST = ("end scan finds nothing", "every tag has a map row and every row a tag", "persons in the nominative, forms merged", "no digits beside BANK and IBAN tags", "no PHONE as AMOUNT, no ID_CARD as PHONE", "addresses in the map without lead-ins")


def report(scores: DataFrame, found: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, report): verdict, table of deductions, numbered findings with their evidence (the first `most`, the rest counted), what is all right, and the checklist."""
    line = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("rule"), F.lit(": "), F.col("evidence"))
    rank = F.expr("CASE severity WHEN 'hard' THEN 0 WHEN 'major' THEN 1 ELSE 2 END")
    nth = F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY k, line)")
    lines = found.select("doc_id", rank.alias("k"), line.alias("line"), "rule").withColumn("nth", nth)
    per = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "line")))).alias("x"), F.count("*").alias("n"), F.collect_set("rule").alias("rules"))
    rows = scores.join(per, "doc_id", "left")
    number = lambda c: F.format_number(c, 1)
    numbered = F.array_join(F.transform("x", lambda x: F.concat(x["nth"].cast("string"), F.lit(". "), x["line"])), "\n")
    areas = {"end scan": "plain_", "map": "map_|tag_not", "types": "_as_|_in_", "persons": "person", "addresses": "address", "typography": "glued|stray"}
    fine = F.concat_ws(", ", *(F.when(~F.coalesce(F.array_join("rules", " ").rlike(p), F.lit(False)), F.lit(a)) for a, p in areas.items()))
    why = F.when(F.col("hard") > 0, F.lit("values in clear or a broken map")).when(F.col("verdict") == "GO", F.lit("no hard fail and a score of 9.3 or more")).otherwise(F.lit("too many lesser faults"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Verdict: "), number(F.col("score")), F.lit("/10, "), F.col("verdict"), F.lit(": "), why),
        *(F.concat(F.lit(f"{title}: "), F.col(s).cast("string")) for s, title in SECTIONS.items()), F.concat(F.lit("Deductions: -"), number(F.col("penalty"))), F.concat(F.lit("Bonuses: +"), number(F.col("bonus"))),
        F.when(F.col("n").isNotNull(), F.concat(F.lit("Findings:\n"), numbered, F.when(F.col("n") > most, F.concat(F.lit("\nand "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit("")))),
        F.concat(F.lit("In order: "), fine), F.lit("Checklist: " + "; ".join(CHECKLIST)),
    )
    return rows.select("doc_id", text.alias("report"))
