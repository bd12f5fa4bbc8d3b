"""WARC derivatives: linked metadata and plain-text conversion records of HTTP responses.

`responses` gives each page the headers of a response record: those it brings along (columns record_id, date, status,
content_type, http_headers), and else an id derived from page_id, url and payload, so that a rerun makes the same
ids. `response_records` makes the WARC response records themselves, `derive` two records of each response: `metadata`
(application/warc-fields with the source's status, headers, length and digest, title, language and links) and
`conversion` (text/plain). Both refer to the response's WARC-Record-ID with WARC-Refers-To and carry its target URI and
date. `save` writes records as WARC files, `read` reads the records of such files, `read_responses` their responses
with ids, dates and headers as they stand there.

Null html is an empty payload; a null url gives no WARC-Target-URI; a null in any other column gives its default;
records of repeated rows are equal, ids too; no pages give no records. Texts are converted whole; columns other than
those named are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

DATE = "1970-01-01T00:00:00Z"
# A comment or script that isn't closed ends with the page; a quoted value holds no "<", so every tag is read once.
_MARK = re.compile(r"<!--(?:.*?-->|.*)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<[/!?a-z][^<>]*>", re.I | re.S)
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "header", "footer", "nav", "main", "aside", "pre", "blockquote", "hr", "title", "form", "dd", "dt", "dl", "body", "head", "html"}
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def text_of(page: str) -> str:
    """The visible text: block elements end lines, runs of white space are one space, blank lines go."""
    flat = _MARK.sub(lambda m: "\n" if m[3] and m[3].lower() in _BLOCK else " " if m[3] is None else "", page.replace("\n", " "))
    lines = (" ".join(x.split()) for x in entities.unescape(flat).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str) -> list[str]:
    found = []
    for m in _MARK.finditer(page):
        if m[3] and m[3].lower() == "a" and (h := _HREF.search(m[4])):
            found.append(entities.unescape(h[1] or h[2] or h[3] or ""))
    return found


def _line(value: str) -> str:
    """A header's value can hold no line break."""
    return " ".join(value.split())


_RESPONSE = ("record_id", "date", "status", "content_type", "http_headers")


def _id(page: object, url: str | None, digest_: str) -> str:
    return record_id("response", str(page), url or "", digest_)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, url, payload, record_id (null: to be derived), date, status, content_type, http_headers of a response record."""
    given = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in pages.columns else F.lit(default)
    payload = F.coalesce("html", F.lit("")).alias("payload")
    defaults = (None, date, "HTTP/1.1 200 OK", "text/html; charset=utf-8", "")
    return pages.select("page_id", "url", payload, *(given(c, d).cast("string").alias(c) for c, d in zip(_RESPONSE, defaults, strict=True)))


_SCHEMA = "page_id {kind}, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, source_digest string, headers string, block string"


def _head(fields: list[tuple[str, str | None]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None)


def _records(rows: DataFrame, make) -> DataFrame:
    """Records of rows of `responses`; make gives tuples in the order of _SCHEMA after page_id."""
    prepare(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = [(row[0], *record) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for record in make(*row)]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            types = [batch.schema.field(0).type, *[pa.string()] * 5, pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.select("page_id", "url", "payload", *_RESPONSE).mapInArrow(run, _SCHEMA.format(kind=rows.schema["page_id"].dataType.simpleString()))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _response(page, url, payload, own, date, status, kind, http_headers):
    sha = digest(_bytes(payload))
    own = own or _id(page, url, sha)
    lines = [status, *(x for x in http_headers.splitlines() if x.strip())]
    if not any(x.lower().startswith("content-type:") for x in lines):
        lines.append(f"Content-Type: {kind}")
    block = "\r\n".join(lines) + "\r\n\r\n" + payload
    data = _bytes(block)
    kind_ = "application/http; msgtype=response"
    head = _head([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", sha), ("WARC-Block-Digest", digest(data)), ("Content-Type", kind_), ("Content-Length", str(len(data)))])
    yield "response", own, None, url, kind_, len(data), digest(data), sha, head, block


def _derived(page, url, payload, own, date, status, kind, http_headers):
    source = _bytes(payload)
    sha = digest(source)
    refers = own or _id(page, url, sha)
    title, lang = _TITLE.search(payload), _LANG.search(payload)
    fields = [("source-status", _line(status)), ("source-content-type", _line(kind)), ("source-content-length", str(len(source))), ("source-payload-digest", sha)]
    fields += [("source-header", _line(x)) for x in http_headers.splitlines() if x.strip()]
    fields += [("title", _line(entities.unescape(title[1])))] if title else []
    fields += [("language", lang[1])] if lang else []
    fields += [("outlink", _line(x)) for x in links(payload)]
    for type_, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", text_of(payload))):
        data = _bytes(block)
        new, block_digest = record_id(type_, refers), digest(data)
        head = _head([("WARC-Type", type_), ("WARC-Record-ID", new), ("WARC-Refers-To", refers), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", block_digest), ("Content-Type", content), ("Content-Length", str(len(data)))])
        yield type_, new, refers, url, content, len(data), block_digest, sha, head, block


def response_records(rows: DataFrame) -> DataFrame:
    """The response record of each row of `responses`."""
    return _records(rows, _response)


def derive(rows: DataFrame) -> DataFrame:
    """Two records for each row of `responses`."""
    return _records(rows, _derived)


def save(records: DataFrame, path: str) -> None:
    """WARC files of records; each ends with two line breaks, as the format asks."""
    records.select(F.concat("headers", F.lit("\r\n"), "block")).write.option("lineSep", "\r\n\r\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block, error) of the records of WARC files, plain or gzip: block are bytes. A record whose block isn't as long as its Content-Length says has an error."""
    prepare(spark)
    # A record ends with two line breaks, and the next begins with the format's name: files are split there.
    rows = spark.read.option("lineSep", "\r\n\r\nWARC/").text(path).select(F.col("value").cast("binary").alias("raw"))

    def run(batches):
        for batch in batches:
            heads, blocks, errors = [], [], []
            for raw in batch.column(0).to_pylist():
                head, found, block = raw.partition(b"\r\n\r\n")
                names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                if not names:
                    continue
                size = names.get(b"content-length", b"")
                if size.isdigit() and len(block) > int(size) and not block[int(size) :].strip():
                    block = block[: int(size)]  # the file's last record keeps its line breaks
                right = bool(found) and size.isdigit() and int(size) == len(block)
                heads.append([(k.decode("latin-1"), v.decode("utf-8", "replace")) for k, v in names.items()])
                blocks.append(block)
                errors.append(None if right else "block length differs from Content-Length")
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary()), pa.array(errors, pa.string())], ["headers", "block", "error"])

    return rows.mapInArrow(run, "headers map<string, string>, block binary, error string")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """page_id (the record's id), url, html, record_id, date, status, content_type, http_headers of the whole response records of WARC files, for `responses`."""
    rows = read(spark, path).filter("headers['warc-type'] = 'response' AND error IS NULL")
    text = F.col("block").cast("string")
    cut = F.locate("\r\n\r\n", text)
    head = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    status = F.substring_index(head, "\r\n", 1)
    own = F.col("headers")["warc-record-id"]
    return rows.select(
        own.alias("page_id"), F.col("headers")["warc-target-uri"].alias("url"), F.when(cut > 0, F.substring(text, cut + 4, F.length(text))).otherwise(F.lit("")).alias("html"), own.alias("record_id"), F.col("headers")["warc-date"].alias("date"),
        status.alias("status"), F.nullif(F.trim(F.regexp_extract(head, r"(?im)^content-type:([^\r\n]*)", 1)), F.lit("")).alias("content_type"), F.substring(head, F.length(status) + 3, F.length(head)).alias("http_headers"),
    )
