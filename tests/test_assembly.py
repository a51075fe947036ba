import json

import pytest
from pyspark.sql import functions as F

from pagewright import __main__ as cli
from pagewright.functions import document
from pagewright.operators import assembly
from pagewright.sources import ooxml
from pagewright.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.pptx").write_bytes(ooxml.write_pptx([("T1", "body"), ("T2", "T2")]))
    (tmp_path / "b.xlsx").write_bytes(ooxml.write_xlsx({"one": [["a", "b"], ["c", "d"]], "two": [["e"]]}))
    (tmp_path / "c.txt").write_text("plain é")
    (tmp_path / "d.xlsx").write_bytes(b"PK\x03\x04 broken")
    return tmp_path


def test_presentation(spark):
    made = spark.createDataFrame([(1, bytearray(ooxml.write_pptx([("T1", "body"), ("T2", "T2")])))], "doc_id bigint, content binary")
    doc = assembly.documents(made.withColumn("format", F.lit("pptx"))).first().doc
    assert (doc.page_count, doc.text) == (2, "# T1\n\nbody\n\n# T2")
    assert [h.text for h in doc.headings] == ["T1", "T2"]


def test_workbook_keeps_the_order_of_sheets(spark):
    made = spark.createDataFrame([(1, bytearray(ooxml.write_xlsx({"one": [["a", "b"]], "two": [["e"]]})))], "doc_id bigint, content binary")
    doc = assembly.documents(made.withColumn("format", F.lit("xlsx"))).first().doc
    assert doc.text == "=== one ===\na\tb\n\n=== two ===\ne\n"
    assert [t.page for t in doc.tables] == [1, 2]


def test_markdown_of_an_empty_document(spark):
    assert one(spark, document.to_markdown(document.document())) == "# Document\n"
    assert one(spark, document.to_markdown(document.document(title=F.lit("x")))) == "# Document\n"
    assert one(spark, document.to_markdown(document.document(filename=F.lit("p/a.b.txt")))) == "# a.b\n"


def test_images(spark):
    image = F.array(F.struct(F.lit(1).alias("page"), F.lit("i").alias("filename"), F.lit("jpg").alias("format"), F.encode(F.lit("hi"), "UTF-8").alias("data")))
    doc = document.document(images=image)
    assert one(spark, document.to_markdown(doc, True)).endswith("![이미지 1](data:image/jpeg;base64,aGk=)\n")
    assert "base64" not in one(spark, document.to_json(doc))
    assert json.loads(one(spark, document.to_json(doc, True)))["images"][0]["base64"] == "aGk="


def test_layout_tables(spark):
    grid = lambda *rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    assert [one(spark, document.is_data_table(g)) for g in (grid("ab"), grid("a", "b"), grid("ab", "c "), grid(["a", " "], [" ", " "]))] == [False, False, True, False]
    assert one(spark, document.is_data_table(F.array().cast("array<array<string>>"))) is False
    assert one(spark, document.row_texts(grid([" a ", ""], ["", " "], ["b", "c"]))) == ["a", "b c"]


def test_command_line(spark, folder, capsys):
    assert cli.main([str(folder), "--md"]) == 0
    out = capsys.readouterr().out
    assert "# a\n" in out and "### 테이블 1" in out and "plain é" in out
    assert cli.main([str(folder / "d.xlsx")]) == 1
    (folder / "e.txt").write_bytes(b"caf\xe9")
    capsys.readouterr()
    assert cli.main([str(folder / "e.txt")]) == 0
    assert capsys.readouterr().out == "café\n"


def test_stream(spark, folder):
    query = ingest.stream_files(spark, str(folder)).select("format").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.format for r in spark.table("seen").collect()) == ["pptx", "txt", "xlsx", "xlsx"]


def test_written(spark):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p/>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc/><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    whole = lambda inner: ooxml._zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{inner}</w:body></w:document>'})
    made = spark.createDataFrame([(1, bytearray(whole(body + table))), (2, bytearray(whole(table))), (3, bytearray(b"no"))], "doc_id bigint, content binary")
    found = assembly.documents(made.withColumn("format", F.lit("docx"))).collect()
    docs = {r.doc_id: r.doc for r in found if r.doc}
    assert set(docs) == {1, 2} and [r.doc_id for r in found if r.error] == [3]
    assert (docs[1].text, [(h.level, h.text) for h in docs[1].headings]) == ("## H\n\nx", [(2, "H")])
    assert docs[2].text == "" and docs[2].tables[0].markdown == "| a |  |\n| --- | --- |\n|  | b |"
