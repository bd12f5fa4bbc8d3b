"""Files of each kind, the command line, and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from zastera.__main__ import main
from zastera.operators.redact import Config
from zastera.sources import files
from zastera.streaming import redact as streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(*runs, inner=""):
    return "<w:p>" + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>" for t in runs) + inner + "</w:p>"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


BOX = "<w:r><w:txbxContent><w:p><w:r><w:t>v rámečku</w:t></w:r></w:p></w:txbxContent></w:r>"
INNER = f"<w:tbl><w:tr><w:tc>{paragraph('vnitřní a@b.cz')}</w:tc></w:tr></w:tbl>"
BODY = paragraph("Jan ", "Novák") + f"<w:tbl><w:tr><w:tc>{paragraph('buňka')}{INNER}</w:tc></w:tr></w:tbl>" + paragraph("s Janem Novákem", inner=BOX) + paragraph()
TEXT = "Jan Novák\ns Janem Novákem\n\nbuňka\nvnitřní a@b.cz\nv rámečku"


def test_docx_paragraphs_come_once():
    assert files.docx_text(docx(BODY)) == TEXT


def test_docx_is_written_back():
    new = files.docx_with(docx(BODY), TEXT.replace("Jan Novák", "[[PERSON_1]]"))
    assert files.docx_text(new) == TEXT.replace("Jan Novák", "[[PERSON_1]]")
    xml = zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml").decode()
    assert xml.count(":b ") + xml.count(":b/") >= 4 and "buňka" in xml  # runs keep their looks


def test_rtf():
    data = r"{\rtf1\ansi\ansicpg1250{\fonttbl{\f0 Arial;}}{\*\generator X;}\f0 Jan Nov\'e1k\par heslo: \{abc\}\tab \u269?\~x\line konec}"
    assert files.rtf_text(data) == "Jan Novák\nheslo: {abc}\tč\xa0x\nkonec"
    assert files.rtf_text("no rtf at all") == "no rtf at all" and files.rtf_text("{{}") == ""


def test_docx_folder_through_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx(BODY))
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    (tmp_path / "in/old_anon.docx").write_bytes(docx(BODY))
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--run", "r", "--audit"]) == 1
    said = capsys.readouterr()
    assert "persons: 1, entities: 2" in said.out and "broken.docx: BadZipFile" in said.err and "Verdict: 10.5/10, GO" in said.out
    new = (tmp_path / "out/r/docx/a_anon.docx").read_bytes()
    assert files.docx_text(new) == "[[PERSON_1]]\ns [[PERSON_1]]\n\nbuňka\nvnitřní [[EMAIL_1]]\nv rámečku"
    found = json.loads(spark.read.text(f"{tmp_path}/out/r/map_json").first()[0])
    assert found["source_file"] == "a.docx" and found["generated_at"].endswith("Z") and found["notes"] and [e["original"] for e in found["entities"]] == ["a@b.cz", "Jan Novák"]
    # The same run again is an error, not an overwrite.
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        main([str(tmp_path / "in/a.docx"), str(tmp_path / "out"), "--run", "r"])


def test_command_line_options(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Zoran Kos, heslo: abc, zoran@example.com, 12345678, Papin")
    (tmp_path / "names.json").write_text('{"firstnames": {"M": ["Zoran"], "F": []}}')
    base = [str(tmp_path / "in/a.txt"), str(tmp_path / "out"), "--format", "text", "--names-json", str(tmp_path / "names.json")]
    assert main([*base, "--run", "r"]) == 0
    read = lambda run: [r["text"] for r in spark.read.parquet(f"{tmp_path}/out/{run}/documents").collect()]
    assert read("r") == ["[[PERSON_1]], heslo: [[PASSWORD_1]], [[EMAIL_1]], [[ICO_1]], Papin"]
    lines = {r[0] for r in spark.read.text(f"{tmp_path}/out/r/map_txt").collect()}
    assert "PASSWORD → [[PASSWORD_1]] : *** (výskyty: 1)" in lines and len(lines) == 4
    assert main([*base, "--run", "s", "--types", "EMAIL,PERSON,FIRMA", "--blacklist", "FIRMA=Papin", "--rename", "PERSON=UŽIVATEL", "--whitelist", "zoran@example.com"]) == 0
    assert read("s") == ["[[UŽIVATEL_1]], heslo: abc, zoran@example.com, 12345678, [[FIRMA_1]]"]
    assert main([*base, "--run", "t", "--min-confidence", "0.6", "--batch"]) == 0 and "12345678" in read("t")[0]
    (tmp_path / "none").mkdir()
    assert main([str(tmp_path / "none"), str(tmp_path / "out")]) == 2 and main([]) == 2 and main([*base, "--blacklist", "x"]) == 2


def test_rtf_folder(spark, tmp_path):
    (tmp_path / "a.rtf").write_bytes(rb"{\rtf1\ansicpg1250 Jan Nov\'e1k\par a@b.cz}")
    assert [r["text"] for r in files.read_rtf(spark, str(tmp_path)).collect()] == ["Jan Novák\na@b.cz"]


@pytest.mark.parametrize("text, want", [('{"male": ["Jan"], "female": ["Eva"]}', (["Jan"], ["Eva"])), ('["Jan", "Eva"]', (["Jan"], ["Eva"])), ('{"firstnames": {"M": ["JAN"], "F": [], "U": ["Nikola"]}}', (["Jan"], ["Nikola"]))])
def test_names_libraries(spark, tmp_path, text, want):
    (tmp_path / "n.json").write_text(text)
    assert files.first_names(spark, str(tmp_path / "n.json")) == want


def test_stream_of_documents(spark, tmp_path):
    rows = [(1, "Jan Novák, a@b.cz, heslo: tajne"), (2, None), (3, "nic")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    streams.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k: r["text"] for k, r in got.items()} == {1: "[[PERSON_1]], [[EMAIL_1]], heslo: [[PASSWORD_1]]", 2: None, 3: "nic"}
    assert {(e["type"], e["original"], tuple(e["variants"])) for e in got[1]["entities"]} == {("PERSON", "Jan Novák", ("Jan Novák",)), ("EMAIL", "a@b.cz", ("a@b.cz",)), ("PASSWORD", "***", ())}


def test_stream_of_paragraphs_keeps_labels(spark, tmp_path):
    schema = "doc_id string, para_no long, text string"
    for k, rows in enumerate([[("x", 1, "c@d.cz"), ("x", 0, "a@b.cz"), ("y", 0, "a@b.cz")], [("x", 2, "c@d.cz a@b.cz"), ("x", 3, None), ("x", 4, "e@f.cz Jan Novák")], [("x", 5, "s Janem Novákem e@f.cz")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    import shutil
    from pathlib import Path

    (tmp_path / "in").mkdir()
    sink = f"{tmp_path}/out"
    for k in range(3):
        for f in Path(f"{tmp_path}/in{k}").glob("*.parquet"):
            shutil.move(f, tmp_path / f"in/{k}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        done = streams.paragraphs(stream, Config())
        done.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["doc_id"], r["para_no"]): (r["text"], [e["label"] for e in json.loads(r["new"])]) for r in spark.read.parquet(sink).collect()}
    assert got == {("x", 0): ("[[EMAIL_1]]", ["[[EMAIL_1]]"]), ("x", 1): ("[[EMAIL_2]]", ["[[EMAIL_2]]"]), ("y", 0): ("[[EMAIL_1]]", ["[[EMAIL_1]]"]), ("x", 2): ("[[EMAIL_2]] [[EMAIL_1]]", []), ("x", 3): (None, []), ("x", 4): ("[[EMAIL_3]] [[PERSON_1]]", ["[[EMAIL_3]]", "[[PERSON_1]]"]), ("x", 5): ("s [[PERSON_1]] [[EMAIL_3]]", [])}


def test_a_stream_plan_has_no_shuffle(spark, tmp_path):
    from zastera.operators.redact import redacted

    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    plan = redacted(spark.read.parquet(f"{tmp_path}/in").withColumn("more", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
