"""Sources and sinks: text, RTF and DOCX files, names libraries, replacement maps, redacted DOCX files."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCUMENT = "word/document.xml"


def _own_texts(paragraph: ElementTree.Element) -> list[ElementTree.Element]:
    """The text elements of a paragraph, without those of paragraphs within it (text boxes)."""
    out, todo = [], list(paragraph)[::-1]
    while todo:
        x = todo.pop()
        if x.tag == f"{_W}t":
            out.append(x)
        elif x.tag != f"{_W}p":
            todo += list(x)[::-1]
    return out


def _elements(root: ElementTree.Element) -> list[list[ElementTree.Element]]:
    """The text elements of every paragraph: of the body, then of table cells and whatever else lies deeper, each once."""
    body = root.find(f"{_W}body")
    if body is None:
        return []
    top = body.findall(f"{_W}p")
    first = {id(p) for p in top}
    return [_own_texts(p) for p in [*top, *(p for p in body.iter(f"{_W}p") if id(p) not in first)]]


def docx_text(data: bytes) -> str:
    """A DOCX file's paragraphs, as lines."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read(DOCUMENT))
    return "\n".join("".join(t.text or "" for t in own).replace("\n", " ") for own in _elements(root))


def docx_with(data: bytes, text: str) -> bytes:
    """The DOCX file with other lines in its paragraphs; those that stay the same keep their runs."""
    source, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    raw = source.read(DOCUMENT)
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(raw), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    root = ElementTree.fromstring(raw)
    for own, line in zip(_elements(root), text.split("\n"), strict=True):
        if own and "".join(t.text or "" for t in own).replace("\n", " ") != line:
            own[0].text = line
            own[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            for t in own[1:]:
                t.text = ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in source.infolist():
            target.writestr(item, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if item.filename == DOCUMENT else source.read(item.filename))
    return out.getvalue()


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
# Groups of an RTF file that hold no text, and control words that stand for characters.
_NO_TEXT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "listtable", "listoverridetable", "themedata", "rsidtbl"}
_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "cell": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(data: str) -> str:
    """The text of an RTF file; bytes above 127 are those of its code page (1250 where none is named)."""
    page = re.search(r"\\ansicpg(\d+)", data)
    code = f"cp{page[1]}" if page else "cp1250"
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, skip, width = False, 0, 1
    for word, number, byte, sign, brace, char in _RTF.findall(data):
        if brace == "{":
            stack.append((silent, width))
        elif brace == "}":
            silent, width = stack.pop() if stack else (False, 1)
        elif word == "uc":
            width = int(number or 1)
        elif word in _NO_TEXT or sign == "*":
            silent = True
        elif silent:
            continue
        elif word == "u":
            out.append(chr(int(number) % 65536))
            skip = width
        elif word:
            out.append(_SIGNS.get(word, ""))
        elif skip and (byte or char):
            skip -= 1
        elif byte:
            out.append(bytes([int(byte, 16)]).decode(code, "replace"))
        elif sign:
            out.append({"~": "\xa0", "_": "-", "-": ""}.get(sign, sign))
        else:
            out.append(char)
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _parsed(files: DataFrame, parse) -> DataFrame:
    """(doc_id = path, text, error): a file that can't be read only gives an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, parse(data), None))
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "error"])

    return files.mapInPandas(run, "doc_id string, text string, error string")


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of the files of a folder, or of one file, but temporary and already redacted ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.startswith("~") & ~name.contains("_anon")).select("path", "content")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id = path, text, error) of DOCX files: body paragraphs, then those of tables and text boxes, as lines."""
    return _parsed(binary_files(spark, path, "*.docx"), docx_text)


def read_rtf(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id = path, text, error) of RTF files."""
    return _parsed(binary_files(spark, path, "*.rtf"), lambda data: rtf_text(data.decode("latin-1")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id = path, text, error) of .txt and .md files."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error"))


READERS = {"docx": read_docx, "rtf": read_rtf, "text": read_text}


def names_library(spark: SparkSession, path: str) -> DataFrame:
    """(name, gender) of a JSON library: {firstnames: {M, F, U}}, {male, female} or a flat array."""
    raw = spark.read.text(path, wholetext=True)
    parse = lambda t: F.from_json("value", t)
    nested = raw.select(parse("struct<firstnames:struct<M:array<string>,F:array<string>,U:array<string>>,male:array<string>,female:array<string>>").alias("j"))
    parts = [nested.select(F.explode(c).alias("name"), F.lit(g).alias("gender")) for c, g in (("j.firstnames.M", "M"), ("j.firstnames.F", "F"), ("j.firstnames.U", "U"), ("j.male", "M"), ("j.female", "F"))]
    out = raw.filter(F.trim("value").startswith("[")).select(F.explode(parse("array<string>")).alias("name"), F.lit("U").alias("gender"))
    for p in parts:
        out = out.unionByName(p)
    return out.select(F.lower("name").alias("name"), "gender").distinct()


#: First names that a library may hold: every worker has all their forms.
MOST_NAMES = 100_000


def first_names(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Male and female names of a library; those without a gender are female if they end in -a."""
    rows = names_library(spark, path).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"{path} holds over {MOST_NAMES} names")
    female = [r["gender"] == "F" or r["gender"] == "U" and r["name"].endswith("a") for r in rows]
    pick = lambda f: sorted({r["name"].capitalize() for r, x in zip(rows, female, strict=True) if x == f})
    return pick(False), pick(True)


def write(docs: DataFrame, json: DataFrame, lines: DataFrame, folder: str, run: str) -> None:
    """Redacted text, JSON map and text map in a folder of the run's own; an existing one is an error."""
    docs.write.mode("errorifexists").parquet(f"{folder}/{run}/documents")
    json.select("json").write.mode("errorifexists").text(f"{folder}/{run}/map_json")
    lines.select("line").write.mode("errorifexists").text(f"{folder}/{run}/map_txt")


def write_docx(spark: SparkSession, source: str, clear: DataFrame, folder: str) -> int:
    """The DOCX files of `source` with the texts of clear (doc_id = path, text), as NAME_anon.docx in a folder that all executors reach by path. Gives their number."""
    rows = clear.filter("text IS NOT NULL").join(binary_files(spark, source, "*.docx").withColumnRenamed("path", "doc_id"), "doc_id")
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches):
        for pdf in batches:
            for path, text, data in zip(pdf["doc_id"], pdf["text"], pdf["content"], strict=True):
                target = Path(folder) / f"{Path(path).stem}_anon.docx"
                # Written whole under another name first: a task that is run again leaves no half file.
                part = target.with_suffix(".part")
                part.write_bytes(docx_with(data, text))
                part.replace(target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
