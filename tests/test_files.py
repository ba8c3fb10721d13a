"""Sources and the engine, from files to answers."""

import json
import zipfile

import pytest

from corvane.__main__ import main
from corvane.engine import Engine
from corvane.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("docs")
    (base / "sub").mkdir()
    (base / "a.txt").write_text("The scanner reads ballots one by one and keeps their images.\n\nshort\n\n" + "x" * 13_000, encoding="utf-8-sig")
    (base / "old.md").write_bytes("Руководство по включению сканера: нажмите кнопку питания и ждите сигнала.".encode("cp1251"))
    (base / "sub" / "t.CSV").write_text("name;size;note\n" + "".join(f"item{k};{k};some note about item {k}\n" for k in range(100)))
    (base / "empty.txt").write_text("")
    (base / "data.txt").write_text(json.dumps({"chunk_id": "c", "content": "x" * 80, "metadata": {}}) + "\n")
    (base / "chunks_1.txt").write_text("y" * 80)
    (base / "skip.bin").write_bytes(b"\x00")
    (base / "broken.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(base / "d.docx", "w") as z:
        cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
        table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("part", "count of parts"), ("lamp", "two lamps"), ("belt", "one long belt"))) + "</w:tbl>"
        z.writestr("word/document.xml", f'<w:document {W}><w:body>{paragraph("Setup", "Heading1")}{paragraph("Put the device on a table and plug it into the socket nearby.")}{table}{paragraph("After words.")}</w:body></w:document>')
    return base


def test_elements(spark, folder):
    found = files.discover(spark, str(folder))
    assert {r["name"] for r in found.select("name").collect()} == {"a.txt", "old.md", "t.CSV", "data.txt", "chunks_1.txt", "broken.docx", "d.docx"}
    got = {}
    for r in files.elements(found).orderBy("source", "elem_ix").collect():
        got.setdefault(r["source"], []).append(r)
    assert set(got) == {"a.txt", "old.md", "t.CSV", "broken.docx", "d.docx"}  # artifacts have no elements
    assert [(r["page"], len(r["content"])) for r in got["a.txt"]] == [(1, 67), (2, 13_000)]
    assert got["old.md"][0]["content"].startswith("Руководство")
    assert [(r["page"], r["num_rows"], r["num_cols"]) for r in got["t.CSV"]] == [(1, 80, 3), (2, 21, 3)]
    assert [r["element_type"] for r in got["d.docx"]] == ["heading", "text", "table", "text"]
    assert got["d.docx"][2]["content"].split("\n")[:2] == ["| part | count of parts |", "| --- | --- |"]
    assert [r["element_type"] for r in got["broken.docx"]] == ["error"]


def test_artifact_names(spark):
    names = spark.createDataFrame([("chunks_a.jsonl",), ("Docstore.txt",), ("bm25x.txt",), ("a.txt",)], "name string")
    rows = names.select("name", files.artifact_kind(names["name"]).alias("k"), files.artifact_priority(files.artifact_kind(names["name"]), True).alias("p")).collect()
    assert [(r["k"], r["p"]) for r in rows] == [("chunks", 2), ("docstore", 1), ("bm25", 4), ("unknown", 0)]


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    engine.index(engine.chunk(engine.ingest(str(folder))))
    store = engine.table("store")
    assert {r["chunk_type"] for r in store.select("chunk_type").distinct().collect()} == {"text", "table"}
    assert store.count() == store.select("chunk_id").distinct().count()
    asked = spark.createDataFrame([(1, "ballots images scanner"), (2, "nothing of that")], "query_id long, query string")
    assert engine.ready()["ready"]
    best = engine.search(asked, 2).where("rank = 1 AND query_id = 1").collect()
    assert best[0]["source"] == "a.txt"
    assert "[Документ: a.txt, стр. 1]" in engine.contexts(engine.search(asked, 2)).where("query_id = 1").collect()[0]["context"]
    assert engine.verify().collect()[0]["status"] == "ok"
    assert engine.export(str(tmp_path / "out")).count() == store.count()
    assert main(["--home", str(tmp_path / "home"), "verify"]) == 0


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "question": "q", "context_text": "c"}, {"question_id": 2, "reference_answer": "r"}]))
    rows = files.evaluation_set(spark, str(tmp_path / "q.json")).orderBy("question_id").collect()
    assert [(r["question_id"], r["context"], r["reference"]) for r in rows] == [("1", "c", None), ("2", None, "r")]
