"""One query for each operator, and the SQL that gives the same rows.

The SQL of the engine's queries runs all detectors in their order over the whole texts, as the engine does: each pass
puts one character in place of a value, and the values are matched with their places at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zastera.functions import names
from zastera.functions.detectors import BY_NAME, DETECTORS, KEEP, MASKED, MASKS, Detector
from zastera.operators import audit, redact
from zastera.operators.common import on_path, scratch_folder, stored
from zastera.streaming import redact as streams

from . import cases

# Sample texts with identifiers, an SQL expression over customer's key k that both engines read.
_K = "CAST(c_custkey AS STRING)"


def _pad(n: int, fill: str = "0") -> str:
    return f"lpad({_K}, {n}, '{fill}')"


SAMPLES = {
    "credentials_username": f"concat('Credentials: user', {_K}, ' / secret', {_K})", "credentials_password": f"concat('Credentials: user', {_K}, ' / secret', {_K})",
    "password": f"concat('Heslo: tajne', {_K}, ', pass-through')", "api_key": f"concat('API_KEY=', {_pad(20, 'a')}, ' API key management')", "secret": f"concat('Stripe: sk_live_', {_pad(20)})",
    "ssh_key": f"concat('ssh-rsa ', {_pad(60, 'A')}, ' me@host')", "iban": f"concat('IBAN CZ65', {_pad(20)}, ' konec')", "card": f"concat('Karta: 4', {_pad(15)}, '.')", "card_bare": f"concat('zaplaceno 4', {_pad(15)}, ' dnes')",
    "username": f"concat('Login: user', {_K}, ' ok')", "account_id": f"concat('Account ID: ', {_pad(12)})", "host": f"concat('Host: db', {_K}, '.example.com,')", "insurance": f"concat('VZP: ', {_pad(10, '7')})",
    "rfid": f"concat('RFID karta: RF-', {_pad(6)}, ', badge colour')", "linkedin": f"concat('viz https://www.linkedin.com/in/osoba-', {_K}, ' zde')", "facebook": f"concat('viz facebook.com/osoba.', {_K}, ' zde')",
    "instagram": f"concat('Instagram: @osoba', {_K}, ', @Override')", "instagram_url": f"concat('viz instagram.com/osoba', {_K}, ' zde')", "skype": f"concat('Skype: live.osoba', {_K}, ' Skype for')", "voice_id": f"concat('Voice ID: V-', {_pad(6)})", "bio_hash": f"concat('otisk FINGERPRINT_', {_K}, ' a IRIS_A', {_K})",
    "photo_id": f"concat('soubor photo_id_', {_K}, '.jpg')", "address": f"concat('bytem Krásná ', CAST(c_custkey % 90 + 1 AS STRING), ', 602 00 Brno a dále')", "address_short": f"concat('bydlí Dlouhá ', CAST(c_custkey % 90 + 1 AS STRING), ', Ostrava.')",
    "birth_date": "concat('nar. ', CAST(c_custkey % 28 + 1 AS STRING), '. 1. 1988, dne 3. 4. 2020')", "birth_place": "concat('Místo narození: ', CASE WHEN c_custkey % 2 = 0 THEN 'Brno' ELSE 'Nový Jičín' END, ', dne')",
    "birth_id": f"concat('dne 850101/', {_pad(4)}, ', FÚ-850101/2020')", "birth_id_context": f"concat('RČ 850101', {_pad(4)}, ' zde')", "bank": f"concat('platba ', CAST(1000000000 + c_custkey AS STRING), '/0100, 12/2024')", "bank_context": f"concat('Číslo účtu: ', CAST(1000000000 + c_custkey AS STRING))",
    "id_card": f"concat('doklad AB ', {_pad(6)}, ', je 123456')", "id_card_context": f"concat('OP č. ', CAST(100000000 + c_custkey AS STRING))", "passport": f"concat('pas č. ', {_pad(8, '5')})", "driver_licence": f"concat('ŘP č. EA', {_pad(6)})",
    "benefit_card": f"concat('MultiSport: MS-', {_pad(8)})", "dic": f"concat('DIČ: CZ', CAST(10000000 + c_custkey AS STRING))", "genetic_id": f"concat('varianta rs', {_pad(7)}, ' a rs12')", "imei": f"concat('IMEI: ', {_pad(15, '3')})",
    "vin": f"concat('VIN: TMB', {_pad(14, '1')})", "vin_trailing": f"concat('TMB', {_pad(14, '1')}, ' vozidlo')", "imei_trailing": f"concat({_pad(15, '3')}, ' mobil')", "phone_bare": "concat('volat ', CAST(600000000 + c_custkey AS STRING), ' ráno')", "phone_abroad": "concat('volat +49 30 ', CAST(600000 + c_custkey AS STRING), ' ráno')", "api_key_loose": f"concat('API key ab', {_pad(8)}, ' konec')", "bio_hash_context": f"concat('Hash: HB', {_pad(12, '7')})", "photo_file": f"concat('Fotografie: uloženo v (foto', {_K}, '.png)')", "card_in_context": f"concat('Karta VISA vydaná bankou, Číslo: 4', {_pad(15)}, '.')", "contract_id": f"concat('smlouva č. 2024/', {_pad(6)}, '.')", "customer_id": f"concat('Zákaznické číslo: Z', {_pad(6)}, '.')", "organisation": f"concat('smlouvu s Papin ', {_K}, ' s.r.o. dnes')", "amount": f"concat('cena ', CAST(c_custkey AS STRING), ' 500,50 Kč dnes')", "date": "concat('dne ', CAST(c_custkey % 28 + 1 AS STRING), '. března 2024 a 2. 3. 2024')", "mac": f"concat('MAC 00:1A:2B:3C:4D:', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'))", "phone_cz": f"concat('Tel: +420 ', lpad(CAST(600000000 + c_custkey AS STRING), 9, '0'), ', 100 000 000 Kč')",
    "phone_context": "concat('mobil: ', CAST(600000000 + c_custkey AS STRING))", "ico": "concat('firma ', CAST(10000000 + c_custkey AS STRING), ' a 123456789')", "ico_context": "concat('IČO ', CAST(10000000 + c_custkey AS STRING))", "plate_bare": "concat('vůz 1AB ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' stál')", "plate": "concat('SPZ: 1AB ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))",
}
TEXTS = ("email", "ipv4", "card_bare", "hex_token", "phone_intl", "api_key")


def _load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    on_path(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Files whose row groups are fewer than half the cores are dealt out first, if they are this small.
SMALL = 1 << 28


def _spread(rows: DataFrame) -> DataFrame:
    """A small table that lies in too few row groups to keep the cores busy, dealt out; any other as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if rows.sparkSession.sparkContext.master.startswith("local") and size < SMALL and cores > 1:
        return rows.repartition(cores)
    return rows


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(_load(spark, sf, "documents").select("doc_id", "text"))


def _sample(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return _load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text"))


#: What stands in every value.
_SIGN = {"email": "@", "ipv4": "[0-9]", "card_bare": "[0-9]", "hex_token": "[0-9]", "phone_intl": "\\+1 ", "api_key": "[:=]"}


def _values(rows: DataFrame, name: str) -> DataFrame:
    d = BY_NAME[name]
    # Most texts hold no sign of a value; where that is cheap to see, they go first.
    if name in _SIGN:
        rows = rows.filter(F.col("text").rlike(_SIGN[name]))
    found = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(d.java), F.lit(2))).alias("value")).filter(redact.valid(d, F.col("value")))
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


_DIGIT = "CAST(substr(z, i, 1) AS INT)"
LUHN = f"""list_sum(list_transform(range(1, length(z) + 1), lambda i: CASE WHEN (length(z) - i) % 2 = 0 THEN {_DIGIT} WHEN 2 * {_DIGIT} > 9 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END)) % 10 = 0 AND length(z) BETWEEN 13 AND 19"""
_CHECKS = {"luhn": LUHN, "birth": "length(z) = 9 OR CAST(z AS BIGINT) % 11 = 0", "phone": "length(z) BETWEEN 8 AND 15", "digit": "length(z) > 0"}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found_sql(name: str, source: str) -> str:
    rows = f"SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(BY_NAME[name].re2)}, 2)) AS value FROM ({source})"
    check = _CHECKS.get(BY_NAME[name].check)
    return f"SELECT doc_id, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS z FROM ({rows})) WHERE {check}" if check else rows


def _values_sql(name: str, source: str) -> str:
    return f"SELECT doc_id, value, count(*) AS n FROM ({_found_sql(name, source)}) GROUP BY doc_id, value"


def extract_text(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return _values(_docs(spark, sf), name)


def extract_sample(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return _values(_sample(spark, sf, SAMPLES[name]), name)


_OTHER = "SELECT 2 * page_id AS doc_id, html AS text FROM pages UNION ALL SELECT 2 * (conv_id * 1000 + turn) + 1 AS doc_id, text FROM conversations"


def _other(spark: SparkSession, sf: str) -> DataFrame:
    rows = _load(spark, sf, "pages").select((2 * F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return rows.unionByName(_load(spark, sf, "conversations").select((2 * (F.col("conv_id") * 1000 + F.col("turn")) + 1).alias("doc_id"), "text"))


def extract_other(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return _values(_other(spark, sf), name)


# The engine over whole documents.


def _done(spark: SparkSession, sf: str, **config) -> DataFrame:
    return redact.redacted(_docs(spark, sf), redact.Config(**config))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return redact.known(_done(spark, sf)).drop("variants", "confidence")


FIRST = 0xE000


@cache
def _passes(extra: tuple[str, ...] = ()) -> list[Detector]:
    return [d for d, _ in redact.Finder(redact.Config(extra=extra), DETECTORS, None).passes]


def _chain_sql(source: str = "SELECT doc_id, text FROM documents", extra: tuple[str, ...] = ()) -> str:
    """WITH ... found (doc_id, i, k, v): the i-th taken place of a text, the pass that took it, and its value; last (doc_id, t); types (k, type, put)."""
    steps, types = [f"s0 AS MATERIALIZED (SELECT doc_id, text AS t, CAST([] AS STRUCT(k INT, v VARCHAR)[]) AS hits FROM ({source}))"], []
    passes = [*_passes(extra), *MASKS]
    for k, d in enumerate(passes):
        p, sign = _quoted(d.re2), f"'{chr(FIRST + k)}'"
        every = f"regexp_extract_all(t, {p}, 2)"
        if d.check:
            keep = f"list_filter({every}, lambda x: list_contains(list_transform([regexp_replace(x, '[^0-9]', '', 'g')], lambda z: {_CHECKS[d.check]}), true))"
            swap = "list_reduce(list_concat([t], list_distinct(own)), lambda a, x: replace(a, x, " + sign + "))"
        else:
            keep, swap = every, f"regexp_replace(t, {p}, '\\1{chr(FIRST + k)}\\3', 'g')"
        inner = f"SELECT doc_id, t, hits, CASE WHEN regexp_matches(t, {p}) THEN {keep} ELSE [] END AS own FROM s{k}"
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT doc_id, CASE WHEN len(own) > 0 THEN {swap} ELSE t END AS t, list_concat(hits, list_transform(own, lambda v: {{'k': {k}, 'v': v}})) AS hits FROM ({inner}))")
        types.append(f"({k}, {_quoted(d.type)}, {_quoted(MASKED.get(d.name, ''))})")
    signs = f"'[{chr(FIRST)}-{chr(FIRST + 255)}]'"
    return f"""WITH {", ".join(steps)},
last AS MATERIALIZED (SELECT doc_id, t, hits FROM s{len(passes)}),
places AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS j FROM (SELECT doc_id, unicode(sign) - {FIRST} AS k, i FROM (SELECT doc_id, unnest(regexp_extract_all(t, {signs})) AS sign, generate_subscripts(regexp_extract_all(t, {signs}), 1) AS i FROM last))),
vals AS (SELECT doc_id, h.k AS k, h.v AS v, row_number() OVER (PARTITION BY doc_id, h.k ORDER BY i) AS j FROM (SELECT doc_id, unnest(hits) AS h, generate_subscripts(hits, 1) AS i FROM last)),
types(k, type, put) AS (VALUES {", ".join(types)}),
found AS MATERIALIZED (SELECT doc_id, i, k, type, put, v FROM places JOIN vals USING (doc_id, k, j) JOIN types USING (k)),
seen AS (SELECT doc_id, type, trim(v) AS original, min(i) AS first, count(*) AS occurrences FROM found WHERE type NOT IN ('{KEEP}', '') GROUP BY ALL),
known AS MATERIALIZED (SELECT doc_id, type, idx, '[[' || type || '_' || CAST(idx AS VARCHAR) || ']]' AS label, original, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS idx FROM seen)),
pieces AS (SELECT doc_id, unnest(string_split_regex(t, {signs})) AS piece, generate_subscripts(string_split_regex(t, {signs}), 1) AS i FROM last),
clear AS (
  SELECT p.doc_id, string_agg(piece || CASE WHEN f.type IS NULL THEN '' WHEN f.type = '{KEEP}' THEN f.v WHEN f.type = '' THEN f.put ELSE l.label END, '' ORDER BY p.i) AS text
  FROM pieces p LEFT JOIN found f ON f.doc_id = p.doc_id AND f.i = p.i LEFT JOIN known l ON l.doc_id = f.doc_id AND l.type = f.type AND l.original = trim(f.v) GROUP BY p.doc_id
)
"""


def label_map(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf)


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).groupBy("type").agg(F.count("*").alias("entities"), F.sum("occurrences").cast("long").alias("occurrences"))


def map_txt_lines(spark: SparkSession, sf: str) -> DataFrame:
    return redact.map_lines(redact.shown(_known(spark, sf))).select("doc_id", "line")


def map_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return redact.map_json(redact.shown(_known(spark, sf)))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors and persons over all documents."""
    return _done(spark, sf).select("doc_id", "text")


def redact_map(spark: SparkSession, sf: str) -> DataFrame:
    return redact.shown(_known(spark, sf))


def redact_optional(spark: SparkSession, sf: str) -> DataFrame:
    """With amounts, dates, organisations and identifiers of contracts and customers."""
    return _done(spark, sf, extra=OPTIONAL_SQL).select("doc_id", "text")


OPTIONAL_SQL = ("AMOUNT", "DATE", "CONTRACT_ID", "CUSTOMER_ID")


def redact_others(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and conversations."""
    return redact.redacted(_other(spark, sf)).select("doc_id", "text")


def redact_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files."""
    schema = _load(spark, sf, "documents").schema
    # A pattern, as a stream takes no path of a single file.
    folder, path = scratch_folder(spark), f"{sf}/documents.parque[t]"
    streams.start(spark.readStream.schema(schema).parquet(path), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "text")


def redact_paragraph_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of conversations, labels kept over them as state."""
    folder = scratch_folder(spark)
    rows = _load(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("para_no"), F.regexp_replace("text", "\n", " ").alias("text"))
    rows.write.parquet(f"{folder}/in")
    done = streams.paragraphs(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "para_no", "text")


def deanonymize(spark: SparkSession, sf: str) -> DataFrame:
    return redact.restored(_done(spark, sf))


def restore_by_map(spark: SparkSession, sf: str) -> DataFrame:
    done = stored(_done(spark, sf), "done")
    return redact.restore(done.select("doc_id", "text"), redact.known(done))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return redact.paragraphs(_docs(spark, sf)).select("doc_id", F.col("para_no").cast("long").alias("para_no"), "text")


def redact_email(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.regexp_replace("text", BY_NAME["email"].java, "$1[[EMAIL]]").alias("text"))


def mask(d: Detector, text: str, spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf, text).select("doc_id", F.regexp_replace("text", d.java, "$1" + MASKED[d.name]).alias("text"))


_MASKS = {"mask_cvv": (MASKS[0], f"concat('CVV: ', {_pad(3)}, ' a cvc ', {_pad(3)})"), "mask_expiry": (MASKS[1], f"concat('exp: 0', CAST(c_custkey % 9 + 1 AS STRING), '/27')")}


def entity_counts_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).join(_load(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "type").agg(F.sum("occurrences").cast("long").alias("n"))


def entities_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).join(_load(spark, sf, "labels"), "doc_id").groupBy("quality", "type").agg(F.count("*").alias("n"))


def docs_with_pii(spark: SparkSession, sf: str) -> DataFrame:
    return _done(spark, sf).filter(F.size("entities") > 0).select("doc_id")


def docs_without_pii(spark: SparkSession, sf: str) -> DataFrame:
    return _done(spark, sf).filter(F.size("entities") <= 0).select("doc_id")


def tag_map_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Tags without a map row, when the rows of type IP are taken away."""
    done = stored(_done(spark, sf), "done")
    return audit.tags(done).join(redact.known(done).filter("type <> 'IP'"), ["doc_id", "label"], "left_anti").select("doc_id", "label", "n")


def map_row_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Map rows without a tag, when the e-mail tags are taken out of the texts."""
    done = stored(_done(spark, sf), "done")
    texts = done.select("doc_id", F.regexp_replace("text", r"\[\[EMAIL_[0-9]+\]\]", "").alias("text"))
    return redact.known(done).join(audit.tags(texts), ["doc_id", "label"], "left_anti").select("doc_id", "label")


def audit_hard_fails(spark: SparkSession, sf: str) -> DataFrame:
    return audit.plain(_docs(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


def audit_score(spark: SparkSession, sf: str) -> DataFrame:
    done = stored(_done(spark, sf), "done")
    return audit.score(done.select("doc_id", "text"), audit.findings(done, redact.known(done)))


def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    done = stored(_done(spark, sf), "done")
    found = stored(audit.findings(done, redact.known(done)), "found")
    return audit.report(audit.score(done, found), found)


def whitelist_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = _sample(spark, sf, f"concat('Login: user', {_K}, ' ok')")
    return redact.redact(docs, redact.Config(types=("USERNAME",), whitelist=("user7",)))[1].drop("variants", "confidence")


def blacklist_force(spark: SparkSession, sf: str) -> DataFrame:
    docs = _sample(spark, sf, f"concat('firma Papin ', {_K}, ' ok')")
    return redact.redact(docs, redact.Config(types=("FIRMA",), blacklist=(("FIRMA", "Papin"),)))[0]


def rename_types(spark: SparkSession, sf: str) -> DataFrame:
    docs = _sample(spark, sf, f"concat('mail u', {_K}, '@firma.cz a Jan Novák')")
    return redact.redact(docs, redact.Config(rename={"EMAIL": "MAIL", "PERSON": "UŽIVATEL"}))[0]


def precedence_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """A DIČ is no phone number and no IČO, an account no birth number."""
    return redact.redact(_sample(spark, sf, f"concat('DIČ: CZ', CAST(100000000 + c_custkey AS STRING), ' účet 123456/0800')"))[0]


def longest_match(spark: SparkSession, sf: str) -> DataFrame:
    """By precedence the e-mail address of a user name wins, by length what is longer."""
    docs = _sample(spark, sf, f"concat('Credentials: a', {_K}, '@b.cz:8080 / tajne')")
    both = [redact.redact(docs, redact.Config(longest=x))[0].withColumn("longest", F.lit(x)) for x in (False, True)]
    return both[0].unionByName(both[1])


def confidence_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """An isolated number of eight digits isn't sure enough for 0.6: it stays, with a warning."""
    docs = _sample(spark, sf, "concat('číslo jednací ', CAST(10000000 + c_custkey AS STRING), ' a IČO ', CAST(20000000 + c_custkey AS STRING))")
    done = redact.redacted(docs, redact.Config(min_confidence=0.6))
    return done.select("doc_id", "text", F.get("warnings", F.lit(0))["type"].alias("type"), F.get("warnings", F.lit(0))["value"].alias("value"))


def normalize_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sample(spark, sf, f"concat('Žluťoučký Kůň ', {_K})")
    return rows.select("doc_id", names.normalize_key(F.col("text")).alias("key"))


# Cases with answers written by hand, dealt over the customers by key; the remainder has the key's sign, as in the SQL.


def _case(spark: SparkSession, sf: str, given: list[str]) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(given)), "k int, text string")
    return _load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % len(given)).cast("int").alias("k")).join(F.broadcast(rows), "k").select("doc_id", "text")


def _case_sql(answers: list[tuple], columns: str) -> str:
    rows = ", ".join("(" + ", ".join([str(k), *("NULL" if x is None else str(x) if isinstance(x, int) else _quoted(x) for x in row)]) + ")" for k, row in enumerate(answers))
    return f"SELECT c_custkey AS doc_id, {columns} FROM customer JOIN (VALUES {rows}) AS answers(k, {columns}) ON c_custkey % {len(answers)} = k"


def detector_cases(spark: SparkSession, sf: str) -> DataFrame:
    return redact.redact(_case(spark, sf, [x for x, _ in cases.DETECTED]))[0]


def optional_cases(spark: SparkSession, sf: str) -> DataFrame:
    return redact.redact(_case(spark, sf, [x for x, _ in cases.OPTIONAL]), redact.Config(extra=redact.OPTIONAL))[0]


def person_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The persons of two words in any case, by their nominative."""
    known = redact.redact(_case(spark, sf, [x for x, _ in cases.PERSONS]), redact.Config(types=("PERSON",)))[1]
    return known.select("doc_id", "original")


def person_link(spark: SparkSession, sf: str) -> DataFrame:
    """One person for all forms: the number of persons, and the first one's forms."""
    done = redact.redacted(_case(spark, sf, [x for x, *_ in cases.LINKED]), redact.Config(types=("PERSON",)))
    return done.select("doc_id", F.size("entities").cast("long").alias("persons"), F.array_join(F.get("entities", F.lit(0))["variants"], ",").alias("variants"))


def person_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return redact.redact(_case(spark, sf, [x for x, _ in cases.SENTENCES]))[0]


def standalone_surnames(spark: SparkSession, sf: str) -> DataFrame:
    return redact.redact(_case(spark, sf, [x for x, _ in cases.SURNAMES_ALONE]), redact.Config(surnames=True))[0]


def surname_nominative(spark: SparkSession, sf: str) -> DataFrame:
    return _case(spark, sf, [x for x, _ in cases.NOMINATIVES]).select("doc_id", names.surname_nominative(F.col("text")).alias("nominative"))


def first_name_nominative(spark: SparkSession, sf: str) -> DataFrame:
    return _case(spark, sf, [x for x, _ in cases.FIRST_NAMES]).select("doc_id", names.first_name_nominative(F.col("text")).alias("nominative"))


def surname_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Those of the forms in a list that belong to a nominative."""
    rows = _case(spark, sf, [f"{x}:{y}" for x, y, _ in cases.VARIANTS]).select("doc_id", F.split("text", ":").alias("x"))
    return rows.select("doc_id", F.array_join(F.array_intersect(F.split(F.col("x")[1], " "), names.surname_variants(F.col("x")[0])), " ").alias("forms"))


def stem_groups(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.udf(names.stem, "string")
    return _case(spark, sf, [x for x, _ in cases.STEMS]).select("doc_id", stem("text").alias("stem"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"extract_{n}": partial(extract_text, n) for n in TEXTS}, **{f"extract_{n}": partial(extract_sample, n) for n in SAMPLES if n not in TEXTS}, "extract_card_sample": partial(extract_sample, "card_bare"), "extract_api_key_sample": partial(extract_sample, "api_key"),
    **{f"extract_other_{n}": partial(extract_other, n) for n in TEXTS}, **{k: partial(mask, *v) for k, v in _MASKS.items()},
    **{f.__name__: f for f in (label_map, occurrences, map_txt_lines, map_json_rows, redact_documents, redact_map, redact_optional, redact_others, redact_stream, redact_paragraph_stream, deanonymize, restore_by_map, paragraphs, redact_email, entity_counts_by_lang, entities_by_label, docs_with_pii, docs_without_pii, tag_map_missing, map_row_unused, audit_hard_fails, audit_score, audit_report, whitelist_filter, blacklist_force, rename_types, precedence_resolve, longest_match, confidence_warnings, normalize_key, detector_cases, optional_cases, person_candidates, person_link, person_backfill, standalone_surnames, surname_nominative, first_name_nominative, surname_variants, stem_groups)},
}


def _sample_sql(text: str) -> str:
    return f"SELECT c_custkey AS doc_id, {text} AS text FROM customer"


def _score_sql() -> str:
    """The audit's rules over the texts and the map that the engine's SQL gives. Bonuses as in audit.score."""
    outside = "SELECT doc_id, regexp_replace(text, '\\[\\[[A-ZÀ-Ž_]+_[0-9]+\\]\\]', chr(10), 'g') AS text FROM clear WHERE text IS NOT NULL"
    plain = " UNION ".join(f"SELECT doc_id, 'plain_{BY_NAME[n].type.lower()}' AS rule, value AS evidence FROM ({_found_sql(n, outside)})" for n in audit.HARD_DETECTORS)
    # The rules' patterns without lookaround.
    texts = {
        "id_card_as_phone": (r"(?i)(?:^|\P{L})(?:OP|pas|občanský průkaz|č\. pasu)\s*:?\s*\[\[PHONE_\d+\]\]", "hard", audit.HARD, 1), "bank_in_case_number": (r"(?i)(?:^|\P{L})(?:FÚ|KS|VS|čj)\s?-?\s?\[\[BANK_\d+\]\]", "major", audit.MAJOR, 1),
        "phone_in_technical_token": (r"(?:IRIS|VOICE|HASH_BIO|DB_GENOME)_\w*\[\[PHONE_\d+\]\]", "major", audit.MAJOR, 1), "card_check_value": (r"(?i)cv[vc]2?\s*:?\s*\d{3,4}(?:\D|$)", "major", audit.MAJOR, 1), "card_expiry": (r"(?i)(?:exp|expirace|platnost)\.?\s*:?\s*\d{2}/\d{2,4}", "major", audit.MAJOR, 1),
        "birth_date_in_clear": (r"(?i)(?:^|\P{L})(?:nar\.|narozen[áaý]?|datum narození)\s*:?\s*\d{1,2}[./-]\s?\d{1,2}[./-]\s?\d{4}", "minor", audit.SMALL, 0), "glued_tag": (r"\]\]\p{L}\w*|\d\[\[(?:BANK|BIRTH_ID|IBAN|PHONE)_\d+\]\]", "minor", audit.SMALL, 0), "stray_sign": (r"\S\.:", "minor", audit.SMALL, 0),
    }
    found = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS severity, CAST({p} AS DOUBLE) AS penalty, 0 AS l, {w} AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(x)})) FROM clear)" for x, s, p, w in texts.values())
    maps = f"SELECT doc_id, 'hard', CAST({audit.HARD} AS DOUBLE), 0, 0 FROM tags ANTI JOIN known USING (doc_id, label) UNION ALL SELECT doc_id, 'hard', CAST({audit.HARD} AS DOUBLE), 0, 0 FROM known WHERE trim(original) = '' UNION ALL SELECT doc_id, 'major', CAST({audit.MAJOR} AS DOUBLE), 0, 0 FROM known ANTI JOIN tags USING (doc_id, label)"
    return _K1 + f""", tags AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\[\\[[A-ZÀ-Ž_]+_[0-9]+\\]\\]')) AS label FROM clear),
findings AS ({found} UNION ALL SELECT doc_id, 'hard', CAST({audit.HARD} AS DOUBLE), 1, 0 FROM ({plain}) UNION ALL {maps}),
sums AS (SELECT d.doc_id, count(*) FILTER (severity = 'hard') AS hard, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, coalesce(sum(penalty), 0) AS penalty, least({audit.MOST_BONUS}, {audit.BONUS} * least(2, 3 - coalesce(max(l), 0) - coalesce(max(w), 0))) AS bonus FROM documents d LEFT JOIN findings USING (doc_id) GROUP BY d.doc_id),
scores AS (SELECT *, round(10 - penalty + bonus, 1) AS score FROM sums)
SELECT doc_id, hard, major, minor, round(penalty, 1) AS penalty, CAST(bonus AS DOUBLE) AS bonus, CAST(score AS DOUBLE) AS score, CASE WHEN score >= {audit.PASS} AND hard = 0 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM scores"""


_K1 = _chain_sql()
_SHOWN = "CASE WHEN type = 'CARD' THEN '***' || right(original, 4) WHEN type IN ('PASSWORD', 'API_KEY', 'SECRET', 'SSH_KEY') THEN '***' ELSE original END"
_CUSTOMER = "CAST(c_custkey AS VARCHAR)"
ORACLES: dict[str, str] = {
    **{f"extract_{n}": _values_sql(n, "SELECT doc_id, text FROM documents") for n in TEXTS}, **{f"extract_{n}": _values_sql(n, _sample_sql(t)) for n, t in SAMPLES.items() if n not in TEXTS}, "extract_card_sample": _values_sql("card_bare", _sample_sql(SAMPLES["card_bare"])), "extract_api_key_sample": _values_sql("api_key", _sample_sql(SAMPLES["api_key"])),
    **{f"extract_other_{n}": _values_sql(n, _OTHER) for n in TEXTS}, **{k: f"SELECT doc_id, regexp_replace(text, {_quoted(d.re2)}, '\\1{MASKED[d.name]}', 'g') AS text FROM ({_sample_sql(t)})" for k, (d, t) in _MASKS.items()},
    "label_map": _K1 + "SELECT * FROM known",
    "occurrences": _K1 + "SELECT type, count(*) AS entities, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM known GROUP BY type",
    "map_txt_lines": _K1 + f"SELECT doc_id, type || ' → ' || label || ' : ' || {_SHOWN} || ' (výskyty: ' || CAST(occurrences AS VARCHAR) || ')' AS line FROM known",
    "map_json_rows": _K1 + f"""SELECT doc_id, '{{"version":"1.0","entities":[' || string_agg('{{"type":"' || type || '","label":"' || label || '","original":"' || {_SHOWN} || '","occurrences":' || CAST(occurrences AS VARCHAR) || '}}', ',' ORDER BY type, idx) || ']}}' AS json FROM known GROUP BY doc_id""",
    "redact_documents": _K1 + "SELECT doc_id, text FROM clear", "redact_map": _K1 + f"SELECT doc_id, type, idx, label, {_SHOWN} AS original, occurrences FROM known",
    "redact_optional": _chain_sql(extra=OPTIONAL_SQL) + "SELECT doc_id, text FROM clear", "redact_others": _chain_sql(_OTHER) + "SELECT doc_id, text FROM clear", "redact_stream": _K1 + "SELECT doc_id, text FROM clear",
    # A conversation's turns as the lines of one text: labels are numbered over all of them.
    "redact_paragraph_stream": _chain_sql("SELECT conv_id AS doc_id, string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
    + ", turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM clear) SELECT CAST(doc_id AS VARCHAR) AS doc_id, turn AS para_no, text FROM lines JOIN turns ON turns.conv_id = lines.doc_id AND turns.nth = lines.nth",
    "deanonymize": "SELECT doc_id, text FROM documents", "restore_by_map": "SELECT doc_id, text FROM documents", "paragraphs": "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no, unnest(string_split(text, chr(10))) AS text FROM documents",
    "redact_email": f"SELECT doc_id, regexp_replace(text, {_quoted(BY_NAME['email'].re2)}, '\\1[[EMAIL]]', 'g') AS text FROM documents",
    "entity_counts_by_lang": _K1 + "SELECT lang, type, CAST(sum(occurrences) AS BIGINT) AS n FROM known JOIN documents USING (doc_id) GROUP BY lang, type", "entities_by_label": _K1 + "SELECT quality, type, count(*) AS n FROM known JOIN labels USING (doc_id) GROUP BY quality, type",
    "docs_with_pii": _K1 + "SELECT doc_id FROM documents SEMI JOIN known USING (doc_id)", "docs_without_pii": _K1 + "SELECT doc_id FROM documents ANTI JOIN known USING (doc_id)",
    "tag_map_missing": _K1 + "SELECT doc_id, label, occurrences AS n FROM known WHERE type = 'IP'", "map_row_unused": _K1 + "SELECT doc_id, label FROM known WHERE type = 'EMAIL'",
    "audit_hard_fails": "SELECT rule, count(*) AS n FROM (" + " UNION ".join(f"SELECT doc_id, 'plain_{BY_NAME[n].type.lower()}' AS rule, value FROM ({_found_sql(n, 'SELECT doc_id, text FROM documents')})" for n in audit.HARD_DETECTORS) + ") GROUP BY rule",
    "audit_score": _score_sql(),
    "whitelist_filter": f"SELECT c_custkey AS doc_id, 'USERNAME' AS type, CAST(1 AS BIGINT) AS idx, '[[USERNAME_1]]' AS label, 'user' || {_CUSTOMER} AS original, CAST(1 AS BIGINT) AS occurrences FROM customer WHERE c_custkey <> 7",
    "blacklist_force": f"SELECT c_custkey AS doc_id, 'firma [[FIRMA_1]] ' || {_CUSTOMER} || ' ok' AS text FROM customer", "rename_types": "SELECT c_custkey AS doc_id, 'mail [[MAIL_1]] a [[UŽIVATEL_1]]' AS text FROM customer",
    "precedence_resolve": "SELECT c_custkey AS doc_id, 'DIČ: [[DIC_1]] účet [[BANK_1]]' AS text FROM customer",
    "longest_match": "SELECT c_custkey AS doc_id, 'Credentials: ' || x || ' / [[PASSWORD_1]]' AS text, longest FROM customer, (VALUES ('[[EMAIL_1]]:8080', false), ('[[USERNAME_1]]', true)) AS v(x, longest)",
    "confidence_warnings": "SELECT c_custkey AS doc_id, 'číslo jednací ' || CAST(10000000 + c_custkey AS VARCHAR) || ' a IČO [[ICO_1]]' AS text, 'ICO' AS type, CAST(10000000 + c_custkey AS VARCHAR) AS value FROM customer",
    "normalize_key": "SELECT c_custkey AS doc_id, 'zlutouckykun' AS key FROM customer",
    "detector_cases": _case_sql([(x,) for _, x in cases.DETECTED], "text"), "optional_cases": _case_sql([(x,) for _, x in cases.OPTIONAL], "text"), "person_candidates": _case_sql([(x,) for _, x in cases.PERSONS], "original"),
    "person_link": _case_sql([x[1:] for x in cases.LINKED], "persons, variants").replace("persons, variants FROM", "CAST(persons AS BIGINT) AS persons, variants FROM", 1), "person_backfill": _case_sql([(x,) for _, x in cases.SENTENCES], "text"), "standalone_surnames": _case_sql([(x,) for _, x in cases.SURNAMES_ALONE], "text"),
    "surname_nominative": _case_sql([(x,) for _, x in cases.NOMINATIVES], "nominative"), "first_name_nominative": _case_sql([(x,) for _, x in cases.FIRST_NAMES], "nominative"), "surname_variants": _case_sql([(x,) for _, _, x in cases.VARIANTS], "forms"), "stem_groups": _case_sql([(x,) for _, x in cases.STEMS], "stem"),
}
