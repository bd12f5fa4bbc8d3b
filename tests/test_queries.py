"""The registered queries: each has SQL or stands in a list with the test that takes its place; documents of all kinds."""

import subprocess
import sys
from pathlib import Path

import pytest

from zastera.operators import redact
from zastera.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).parents[1]
#: Queries without SQL, and where they are tested instead.
TESTED = {"audit_report": "test_audit.py"}

TEXTS = ["call +1 (555) 123-4567 now", "paid 4111111111111111 today", "paid 4111111111111112", 'token = "' + "ab" * 20 + '"', "mail a@b.com\nor +1 (555) 123-4567", "Heslo: tajne7", "IBAN CZ6508000000192000145399 end", "RČ 850101/1234 x", "host 10.0.0.1 up", "nothing\nhere", None, "", "Jan Novák"]
KNOWN = [(0, "PHONE", "+1 (555) 123-4567"), (1, "CARD", "4111111111111111"), (3, "API_KEY", "ab" * 20), (4, "EMAIL", "a@b.com"), (4, "PHONE", "+1 (555) 123-4567"), (5, "PASSWORD", "tajne7"), (6, "IBAN", "CZ6508000000192000145399"), (7, "BIRTH_ID", "850101/1234"), (8, "IP", "10.0.0.1"), (12, "PERSON", "Jan Novák")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, t, "en" if k % 2 else "cs") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == set(TESTED) and set(ORACLES) <= set(QUERIES)
    assert all((ROOT / "tests" / f).exists() for f in TESTED.values())


def test_who_has_personal_data(spark, sf):
    ids = lambda name: {r["doc_id"] for r in QUERIES[name](spark, sf).collect()}
    want = {k for k, _, _ in KNOWN}
    assert ids("docs_with_pii") == want and ids("docs_without_pii") == set(range(len(TEXTS))) - want


def test_maps_and_counts(spark, sf):
    rows = lambda name: QUERIES[name](spark, sf).collect()
    assert {(r["doc_id"], r["type"], r["original"]) for r in rows("label_map")} == set(KNOWN)
    types = [t for _, t, _ in KNOWN]
    assert {r["type"]: r["entities"] for r in rows("occurrences")} == {t: types.count(t) for t in types}
    assert {(r["lang"], r["type"]): r["n"] for r in rows("entity_counts_by_lang")} == {("en" if k % 2 else "cs", t): sum(u == t and j % 2 == k % 2 for j, u, _ in KNOWN) for k, t, _ in KNOWN}
    assert {r["doc_id"]: r["text"] for r in rows("deanonymize")} == dict(enumerate(TEXTS)) == {r["doc_id"]: r["text"] for r in rows("restore_by_map")}
    assert [(r["doc_id"], r["label"]) for r in rows("tag_map_missing")] == [(8, "[[IP_1]]")] and [(r["doc_id"], r["label"]) for r in rows("map_row_unused")] == [(4, "[[EMAIL_1]]")]
    lines = {r["line"] for r in rows("map_txt_lines")}
    assert {"CARD → [[CARD_1]] : ***1111 (výskyty: 1)", "PASSWORD → [[PASSWORD_1]] : *** (výskyty: 1)"} < lines and len(rows("map_json_rows")) == 9
    assert {r["rule"]: r["n"] for r in rows("audit_hard_fails")} == {"plain_card": 1, "plain_api_key": 1, "plain_email": 1, "plain_password": 1, "plain_iban": 1, "plain_birth_id": 1}


def test_surname_variants_by_its_sql(spark, tmp_path):
    """With keys of every remainder, repeated, negative and null."""
    duckdb = pytest.importorskip("duckdb")
    keys = [*range(-30, 31), 5, 5, -7, 2**62, -(2**62), None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
        want = db.execute(ORACLES["surname_variants"]).fetchall()
    assert want and sorted(map(tuple, QUERIES["surname_variants"](spark, str(tmp_path)).collect())) == sorted(want)


def test_the_flagship_plan_is_one_narrow_stage(spark, sf):
    plan = QUERIES["redact_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # A small table in few files is dealt out on a local master; nothing else moves.
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") <= 2 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_all_types_are_run_by_the_queries():
    assert {d.type for d, _ in redact.Finder(redact.Config(), redact.DETECTORS, None).passes} >= {t for _, t, _ in KNOWN} - {"PERSON"}


def test_entry_without_the_training_operators(tmp_path):
    """Left-over byte code doesn't count as the package."""
    code = f"""
import sys, types
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
assert 'redact_documents' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "zastera", tmp_path / "zastera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "zastera/llm/__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
