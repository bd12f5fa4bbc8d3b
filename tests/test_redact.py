"""The engine: the whole example, hand-written cases, a plain version, rows of any kind, options, restoring."""

import random
import re

import pytest
from pyspark.sql import functions as F

from zastera.functions.detectors import BY_NAME, CHECKS, DETECTORS, KEEP, PRECEDENCE, rank
from zastera.operators import audit, redact
from zastera.plans import cases

GOLDEN = "Dne 12. 5. 2024 uzavřel Jan Novák, nar. 1. 1. 1988, bytem Křenová 14, 602 00 Brno,\nsmlouvu s Papin s.r.o. Číslo účtu: 123456789/0100. Kontakt: jan.novak@example.com, +420 777 123 456.\nSPZ vozidla ABC1234."
CLEAR = "Dne 12. 5. 2024 uzavřel [[PERSON_1]], nar. [[BIRTH_DATE_1]], bytem [[ADDRESS_1]],\nsmlouvu s Papin s.r.o. Číslo účtu: [[BANK_1]]. Kontakt: [[EMAIL_1]], [[PHONE_1]].\nSPZ vozidla [[LICENSE_PLATE_1]]."


def work(text, **config):
    """(redacted text, entities, unsure) of one text, without Spark."""
    c = redact.Config(**config)
    hits, unsure, masks = redact.Finder(c, DETECTORS, None).find([text])[0]
    return *redact.rendered(text, hits, masks, c.rename), unsure


def test_golden_document(spark):
    docs = spark.createDataFrame([(1, GOLDEN), (2, None), (3, "")], "doc_id long, text string")
    done = redact.redacted(docs).persist()
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {1: CLEAR, 2: None, 3: ""}
    known = redact.known(done)
    assert {(r["type"], r["original"], r["occurrences"]) for r in known.collect()} == {("PERSON", "Jan Novák", 1), ("BIRTH_DATE", "1. 1. 1988", 1), ("ADDRESS", "Křenová 14, 602 00 Brno", 1), ("BANK", "123456789/0100", 1), ("EMAIL", "jan.novak@example.com", 1), ("PHONE", "+420 777 123 456", 1), ("LICENSE_PLATE", "ABC1234", 1)}
    assert {r["doc_id"]: r["text"] for r in redact.restored(done).collect()} == {1: GOLDEN, 2: None, 3: ""}
    assert {r["verdict"] for r in audit.score(done, audit.findings(done, known)).collect()} == {"GO"}
    # With the person in clear the audit says no, once it is told to look for persons: the map's row isn't used.
    broken = done.withColumn("text", F.replace("text", F.lit("[[PERSON_1]]"), F.lit("Jan Novák")))
    assert "map_row_unused" in {r["rule"] for r in audit.findings(broken, known).collect()}


@pytest.mark.parametrize("text, want", [x for x in cases.DETECTED if x[0] is not None])
def test_detectors(text, want):
    assert work(text)[0] == want


@pytest.mark.parametrize("text, want", cases.OPTIONAL)
def test_optional_types(text, want):
    assert work(text, extra=redact.OPTIONAL)[0] == want


def test_every_detector_has_a_case():
    """Positive ones: those whose type stands in the answers, and guards whose text stays."""
    found = set()
    for text, _ in [*cases.DETECTED, *cases.OPTIONAL]:
        c = redact.Config(extra=redact.OPTIONAL)
        f = redact.Finder(c, DETECTORS, None)
        free = text or ""
        for d, p in f.passes:
            for m in p.finditer(free):
                if m[2] and CHECKS[d.check](m[2]):
                    found.add(d.name)
                    free = free[: m.start(2)] + "\ue000" * len(m[2]) + free[m.end(2) :]
    assert {d.name for d in DETECTORS} - found == set()


def plain(text):
    """The same by letters: each is free or taken; no anchors, no joined texts, one detector after another."""
    owner = [None] * len(text)
    out = []
    for d, pattern in redact.Finder(redact.Config(), DETECTORS, None).passes:
        free = "".join(c if o is None else "\ue000" for c, o in zip(text, owner, strict=True))
        for m in list(pattern.finditer(free)):
            if m[2] and CHECKS[d.check](m[2]):
                owner[m.start(2) : m.end(2)] = [d] * len(m[2])
                out.append((m.start(2), d.type, m[2].strip()))
    return [x[1:] for x in sorted(out) if x[1] != KEEP]


def test_the_engine_is_the_plain_version(spark):
    rnd = random.Random(2)
    values = [x for x, _ in cases.DETECTED if x and "Karta" not in x and "Platební" not in x and "Fotografie" not in x]
    glue = [" ", "x", "\n", ", ", "", ": ", "/"]
    texts = ["".join(rnd.choice(values)[rnd.randrange(3) :] + rnd.choice(glue) for _ in range(rnd.randrange(1, 7))) for _ in range(400)]
    config = redact.Config(types=tuple({d.type for d in DETECTORS} - set(redact.OPTIONAL) - {KEEP}))
    finder = redact.Finder(config, DETECTORS, None)
    wrong = []
    for t, (hits, _, _) in zip(texts, finder.find(texts), strict=True):
        own = [(h.type, t[h.start : h.stop].strip()) for h in hits if not (h.type == "ADDRESS")]
        want = [x for x in plain(t) if x[0] != "ADDRESS"]
        if own != want:
            wrong.append((t, own, want))
    assert not wrong
    # The same texts one by one, and through Spark.
    assert [finder.find([t])[0] for t in texts] == finder.find(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in redact.redacted(docs, config).collect():
        hits, _, masks = finder.find([texts[r["doc_id"]]])[0]
        assert r["text"] == redact.rendered(texts[r["doc_id"]], hits, masks, {})[0]


def test_lines_without_a_sign_hold_nothing():
    """Looking at every line finds the same."""
    texts = [line for x, _ in [*cases.DETECTED, *cases.OPTIONAL, *cases.SENTENCES] for line in (x or "").split("\n")]
    config = redact.Config(extra=redact.OPTIONAL)
    some, every = (redact.Finder(c, DETECTORS, None) for c in (config, config._replace(blacklist=(("NONE", "a value that is nowhere"),))))
    assert every.every_line and not some.every_line
    assert some.find(texts) == every.find(texts)


def test_rows_are_independent(spark):
    rows = [(1, "a@b.cz x"), (1, "c@d.cz y"), (None, "e@f.cz"), (None, None), (2, "a@b.cz a@b.cz\nc@d.cz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("entities", F.lit("clash")).withColumn("label", F.lit(1))
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in redact.redacted(docs).collect())
    assert got == [("1", "[[EMAIL_1]] x"), ("1", "[[EMAIL_1]] y"), ("2", "[[EMAIL_1]] [[EMAIL_1]]\n[[EMAIL_2]]"), ("None", "None"), ("None", "[[EMAIL_1]]")]
    back = sorted((str(r["doc_id"]), str(r["text"])) for r in redact.restored(redact.redacted(docs)).collect())
    assert back == sorted((str(k), str(t)) for k, t in rows)
    assert redact.redacted(docs.limit(0)).collect() == []


def test_tags_in_the_input_come_back(spark):
    text = "viz [[EMAIL_1]], a@b.cz a [[FOO_7]]"
    done = redact.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).persist()
    assert done.first()["text"] == "viz [[TAG_1]], [[EMAIL_1]] a [[TAG_2]]"
    assert redact.restored(done).first()["text"] == text
    assert redact.restore(done.select("doc_id", "text"), redact.known(done)).first()["text"] == text


def test_a_very_long_text():
    text = "".join(f"u{k % 500}@firma.cz a text {k} nic\n" for k in range(20_000))
    clear, entities, _ = work(text)
    assert len(entities) == 500 and sum(e["occurrences"] for e in entities) == 20_000 and "@" not in clear


def test_options():
    assert work("mail a@b.cz", rename={"EMAIL": "POŠTA"})[0] == "mail [[POŠTA_1]]"
    assert work("mail a@b.cz, c@d.cz", whitelist=("a@b.cz",))[0] == "mail a@b.cz, [[EMAIL_1]]"
    assert work("firma Papin a.s.", blacklist=(("FIRMA", "Papin"),))[0] == "firma [[FIRMA_1]] a.s."
    assert work("mail a@b.cz, 10.0.0.1", types=("IP",))[0] == "mail a@b.cz, [[IP_1]]"
    assert work("Jan Novák (J. N.)", keep_initials=True)[0] == "[[PERSON_1]] (J. N.)"
    assert work("Jan Novák (J. N.)")[0] == "[[PERSON_1]] ([[PERSON_1]])"
    clear, _, unsure = work("kód 12345678", min_confidence=0.6)
    assert clear == "kód 12345678" and [(h.type, h.original) for h in unsure] == [("ICO", "12345678")]
    clear, _, unsure = work("Jan Novák", whitelist=("Jan Novák",))
    assert clear == "Jan Novák" and unsure == []


def test_longest_match_wins():
    text = "Credentials: jan@firma.cz:8080 / tajne"
    assert work(text)[0] == "Credentials: [[EMAIL_1]]:8080 / [[PASSWORD_1]]"
    assert work(text, longest=True)[0] == "Credentials: [[USERNAME_1]] / [[PASSWORD_1]]"
    assert work("IBAN CZ6508000000192000145399, a@b.cz", longest=True)[0] == "IBAN [[IBAN_1]], [[EMAIL_1]]"


def test_precedence_is_the_list_s_order():
    for group in ([d for d in DETECTORS if d.confidence >= 0.98 and d.type in PRECEDENCE[:12] and d.name not in ("ssh_key",)],):
        ranks = [rank(d.type) for d in group]
        assert ranks == sorted(ranks)
    # Glued values: the stronger type takes what both could.
    assert work("RČ 850101/1234")[0] == "RČ [[BIRTH_ID_1]]" and work("123456/1234")[0] == "[[BANK_1]]"


def test_technical_tokens_keep_their_digits():
    assert work("IRIS_SCAN_X777123456 a DB_GENOME_777123456")[0] == "[[BIO_HASH_1]] a DB_GENOME_777123456"


def test_maps(spark):
    docs = spark.createDataFrame([(1, "Jan Novák a Janem Novákem, heslo: tajne, Karta: 4111111111111111, a@b.cz")], "doc_id long, text string")
    known = redact.shown(redact.redact(docs)[1])
    lines = {r["line"] for r in redact.map_lines(known).collect()}
    assert lines == {"PERSON → [[PERSON_1]] : Jan Novák (výskyty: 2)", "PASSWORD → [[PASSWORD_1]] : *** (výskyty: 1)", "CARD → [[CARD_1]] : ***1111 (výskyty: 1)", "EMAIL → [[EMAIL_1]] : a@b.cz (výskyty: 1)"}
    text = redact.map_text(known).first()["text"]
    assert text.startswith("OSOBY\n-----\n[[PERSON_1]]: Jan Novák (Jan Novák, Janem Novákem), výskyty: 2\n\nCARD\n") and "tajne" not in text and "4111" not in text.replace("***1111", "")
    json = redact.map_json(known, "2025-11-03T12:34:56Z", F.lit("vstup.txt"), ("poznámka",)).first()["json"]
    assert json.startswith('{"version":"1.0","generated_at":"2025-11-03T12:34:56Z","source_file":"vstup.txt","entities":[{"type":"CARD"') and json.endswith('"notes":["poznámka"]}')


@pytest.mark.parametrize("name", [d.name for d in DETECTORS])
def test_patterns_are_alike_in_java(spark, name):
    """Python's and Java's finds on all cases."""
    d = BY_NAME[name]
    texts = [x for x, _ in [*cases.DETECTED, *cases.OPTIONAL] if x]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.regexp_extract_all("text", F.lit(d.java), F.lit(2)).alias("x")).collect()
    for r in rows:
        assert [x for x in r["x"] if x] == [m[2] for m in d.compiled().finditer(texts[r["k"]]) if m[2]]


def test_no_pattern_crosses_lines():
    for d in DETECTORS:
        for text, _ in [*cases.DETECTED, *cases.OPTIONAL]:
            for m in d.compiled().finditer((text or "").replace(" ", "\n")):
                assert "\n" not in m[2] and not re.search(r"\n.", m[0][1:])
