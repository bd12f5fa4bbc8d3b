"""Audit rules on texts and maps written by hand: what each finds and what it costs."""

import pytest

from zastera.operators import audit

MAP = "doc_id long, type string, idx long, label string, original string, occurrences long"
# (text, map rows (type, original), rules found).
CASES = [
    ("[[EMAIL_1]] je tu", [("EMAIL", "a@b.cz")], []),
    ("a@b.cz je tu", [], ["plain_email"]),
    ("platba 4111111111111111 dnes", [], ["plain_card"]),
    ("platba 4111111111111112 dnes", [], []),
    ("heslo: tajne", [], ["plain_password"]),
    ("API_KEY=abcd1234efgh5678", [], ["plain_api_key"]),
    ("IBAN CZ65 0800 0000 1920 0014 5399", [], ["plain_iban"]),
    ("rodné číslo: 850101/1234", [], ["plain_birth_id"]),
    ("OP: [[PHONE_1]]", [("PHONE", "777123456")], ["id_card_as_phone"]),
    ("cena [[AMOUNT_1]]", [("AMOUNT", "777 123 456")], ["phone_as_amount"]),
    ("[[EMAIL_1]]", [], ["tag_not_in_map"]),
    ("[[EMAIL_1]]", [("EMAIL", " ")], ["map_value_empty"]),
    ("nic", [("EMAIL", "a@b.cz")], ["map_row_unused"]),
    ("FÚ-[[BANK_1]]", [("BANK", "1234567/2020")], ["bank_in_case_number"]),
    ("IRIS_A[[PHONE_1]]", [("PHONE", "777123456")], ["phone_in_technical_token"]),
    ("[[CARD_1]], CVV: 123", [("CARD", "4111111111111111")], ["card_check_value"]),
    ("[[CARD_1]], exp: 01/27", [("CARD", "4111111111111111")], ["card_expiry"]),
    ("[[CARD_1]], CVV: ***", [("CARD", "4111111111111111")], []),
    ("[[CARD_1]]", [("CARD", "CZ6508000000192000145399")], ["iban_as_card"]),
    ("[[PERSON_1]]", [("PERSON", "Jan Novák, Eva Malá")], ["two_persons_in_one"]),
    ("[[PERSON_1]]", [("PERSON", "Janem Novákem")], ["person_not_nominative"]),
    ("[[PERSON_1]]", [("PERSON", "Jan Procházka")], []),
    ("[[ADDRESS_1]]", [("ADDRESS", "Sídlo: Křenová 14, 602 00 Brno")], ["address_prefix"]),
    ("nar. 1. 1. 1988", [], ["birth_date_in_clear"]),
    ("[[EMAIL_1]]Tel", [("EMAIL", "a@b.cz")], ["glued_tag"]),
    ("1928[[BIRTH_ID_1]]", [("BIRTH_ID", "850101/1234")], ["glued_tag"]),
    ("konec.: nic", [], ["stray_sign"]),
    (None, [], []),
]
PENALTY = {**dict.fromkeys(("person_not_nominative",), 0.5), **dict.fromkeys(("address_prefix", "birth_date_in_clear", "glued_tag", "stray_sign"), 0.3), **dict.fromkeys(("map_row_unused", "bank_in_case_number", "phone_in_technical_token", "card_check_value", "card_expiry", "iban_as_card", "two_persons_in_one"), 1.0)}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    rows = [(k, t, 1, f"[[{t}_1]]", v, 1) for k, (_, own, _) in enumerate(CASES) for t, v in own]
    return docs, spark.createDataFrame(rows, MAP)


def test_rules_and_scores(tables):
    found = audit.findings(*tables).collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append(r["rule"])
        assert r["penalty"] == PENALTY.get(r["rule"], 3.0)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, (_, _, v) in enumerate(CASES) if v}
    for r in audit.score(tables[0], audit.findings(*tables)).collect():
        rules = CASES[r["doc_id"]][2]
        wrong = {"id_card_as_phone", "phone_as_amount", "iban_as_card", "bank_in_case_number", "phone_in_technical_token", "card_check_value", "card_expiry"}
        earned = 3 - any(x.startswith("plain_") for x in rules) - bool(wrong & set(rules)) - ("person_not_nominative" in rules)
        penalty = sum(PENALTY.get(x, 3.0) for x in rules)
        score = round(10 - penalty + min(0.5, 0.3 * min(2, earned)), 1)
        assert (r["score"], r["verdict"]) == (pytest.approx(score), "GO" if score >= 9.3 and not any(PENALTY.get(x, 3.0) == 3.0 for x in rules) else "NO-GO")


def test_test_mode_wants_whole_values(spark):
    docs = spark.createDataFrame([(1, "[[CARD_1]]")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "CARD", 1, "[[CARD_1]]", "***1111", 1)], MAP)
    assert [r["rule"] for r in audit.findings(docs, known, test_mode=True).collect()] == ["map_value_redacted"] and audit.findings(docs, known).collect() == []


def test_report(tables):
    found = audit.findings(*tables)
    got = {r["doc_id"]: r["report"] for r in audit.report(audit.score(tables[0], found), found, most=1).collect()}
    assert len(got) == len(CASES) and got[0].startswith("Verdict: 10.5/10, GO: no hard fail") and "In order: end scan, map, types, persons, addresses, typography" in got[0]
    assert "1. [hard] plain_email: a@b.cz" in got[1] and "NO-GO: values in clear" in got[1] and "end scan, map" not in got[1] and "Deductions: -3.0" in got[1]


def test_empty_tables(spark, tables):
    docs, known = (t.limit(0) for t in tables)
    found = audit.findings(docs, known)
    assert found.collect() == [] and audit.score(docs, found).collect() == []
