"""WARC records by the format's rules: lengths, digests, references, and a way there and back."""

import base64
import hashlib

from pyspark.sql import functions as F

from zastera.llm import warc

PAGES = [
    (1, "http://a/?q=1", "<html lang=cs><title>Ti &amp; tul</title><p>x &amp; ž<script>z</script></p><!-- <p>no</p> --><a href='/q'>l</a><style>p{}</style><a href=b>m</a>"),
    (2, None, None), (3, "http://b/", ""), (4, "http://c/\r\nX: y", "<p>a\r\n\r\nWARC/1.1\r\nb"), (1, "http://a/?q=1", "<p>same id, other page"), (None, "http://d/", "<pre>" + "w " * 50_000), (6, "http://e/", "<title>no end"), (6, "http://e/", "<title>no end"),
]


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def fields(headers):
    first, *rest = headers.split("\r\n")
    assert first == "WARC/1.1" and rest[-1] == ""
    return dict(x.split(": ", 1) for x in rest[:-1])


def test_records_are_whole_and_linked(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit("clash")).withColumn("headers", F.lit(1))
    rows = warc.responses(pages)
    sources, derived = warc.response_records(rows).collect(), warc.derive(rows).collect()
    assert len(sources) == len(PAGES) and len(derived) == 2 * len(PAGES)
    ids = {r["record_id"]: r for r in sources}
    assert len(ids) == len(PAGES) - 1  # of equal rows the records are equal
    for r in [*sources, *derived]:
        h = fields(r["headers"])
        assert h["WARC-Type"] == r["record_type"] and h["WARC-Record-ID"] == r["record_id"] and h["WARC-Record-ID"].startswith("<urn:uuid:")
        assert int(h["Content-Length"]) == r["content_length"] == len(r["block"].encode()) and h["WARC-Block-Digest"] == r["block_digest"] == sha1(r["block"])
        assert ("WARC-Target-URI" in h) == (r["target_uri"] is not None) and h["WARC-Date"] == warc.DATE
    for r in derived:
        source = ids[r["refers_to"]]
        assert fields(r["headers"])["WARC-Refers-To"] == source["record_id"] and r["source_digest"] == source["source_digest"] == fields(source["headers"])["WARC-Payload-Digest"] and r["target_uri"] == source["target_uri"]
    one = {r["record_type"]: r["block"] for r in derived if r["page_id"] == 1 and "Ti & tul" in r["block"]}
    assert one["conversion"] == "Ti & tul\nx & ž\nl m"
    assert one["metadata"].split("\r\n")[:2] == ["source-status: HTTP/1.1 200 OK", "source-content-type: text/html; charset=utf-8"] and one["metadata"].endswith("title: Ti & tul\r\nlanguage: cs\r\noutlink: /q\r\noutlink: b\r\n")


def test_incoming_ids_dates_and_headers_are_kept(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x", "<urn:uuid:7>", "2024-05-12T00:00:00Z", "HTTP/1.1 404 Not Found", "Server: s\r\nContent-Type: text/html; charset=cp1250"), (2, "http://b/", "<p>y", None, None, None, None)], "page_id long, url string, html string, record_id string, date string, status string, http_headers string")
    rows = warc.responses(pages)
    source = {r["page_id"]: r for r in warc.response_records(rows).collect()}
    assert source[1]["record_id"] == "<urn:uuid:7>" and source[1]["block"] == "HTTP/1.1 404 Not Found\r\nServer: s\r\nContent-Type: text/html; charset=cp1250\r\n\r\n<p>x" and fields(source[1]["headers"])["WARC-Date"] == "2024-05-12T00:00:00Z"
    made = [r for r in warc.derive(rows).collect() if r["page_id"] == 1]
    assert {r["refers_to"] for r in made} == {"<urn:uuid:7>"} and "source-status: HTTP/1.1 404 Not Found\r\n" in made[0]["block"] and "source-header: Server: s\r\n" in made[0]["block"]


def test_files_there_and_back(spark, tmp_path):
    pages = spark.createDataFrame([p for p in PAGES if p[0] != 4], "page_id long, url string, html string")
    rows = warc.responses(pages)
    every = warc.response_records(rows).unionByName(warc.derive(rows))
    warc.save(every.coalesce(2), f"{tmp_path}/out")
    back = warc.read(spark, f"{tmp_path}/out").collect()
    assert all(r["error"] is None for r in back)
    want = sorted((r["record_id"], r["record_type"], r["block"]) for r in every.collect())
    assert sorted((r["headers"]["warc-record-id"], r["headers"]["warc-type"], bytes(r["block"]).decode()) for r in back) == want
    # What is read is derived from under the same ids.
    again = warc.derive(warc.responses(warc.read_responses(spark, f"{tmp_path}/out")))
    key = lambda rows: sorted((r["record_id"], r["refers_to"], r["block"]) for r in rows)
    assert [x[:2] for x in key(again.collect())] == [x[:2] for x in key(warc.derive(rows).collect())]
    assert {x[2] for x in key(again.filter("record_type = 'conversion'").collect())} == {x[2] for x in key(warc.derive(rows).filter("record_type = 'conversion'").collect())}


def test_broken_records_have_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\nWARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n")
    got = {r["headers"]["warc-type"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert got["response"]["error"] and got["metadata"]["error"] is None and bytes(got["metadata"]["block"]) == b"ok"
    assert warc.read_responses(spark, str(tmp_path)).collect() == []


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(none)).collect() == [] and warc.response_records(warc.responses(none)).collect() == []
