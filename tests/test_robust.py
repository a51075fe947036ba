"""Broken files of every format give error rows and never end the job."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import pagewright
from pagewright.functions import encodings
from pagewright.operators import assembly, images, tagged
from pagewright.sources import compound, files, ooxml, pdf

WHOLE = {
    "pdf": lambda: pdf.write([[("some words", 72, 700, 0)]], extra=[b"<</Type/StructTreeRoot/K 1001 0 R>>", b"<</S/H1/Pg 4 0 R/K 0>>"], catalog=b"/StructTreeRoot 1000 0 R", info=b"/Title (T)"),
    "docx": lambda: ooxml.write_docx([("Heading1", "words"), ("", "more")]),
    "pptx": lambda: ooxml.write_pptx([("a", "b"), ("c", "d")]),
    "xlsx": lambda: ooxml.write_xlsx({"s": [["x", "y"], ["z", "w"]]}),
    "hwpx": lambda: ooxml.write_hwpx([("x", 1), "y"], {"title": "t"}),
    "doc": lambda: compound.write_doc(["one", "two"]),
    "ppt": lambda: compound.write({"PowerPoint Document": b"\0\0\xa0\x0f\x04\0\0\0a\0b\0"}),
    "xls": lambda: compound.write({"Workbook": b"\x85\0\x0b\0\x17\0\0\0\0\0\x03\0Tab\0\0\0\x04\x02\x0c\0\0\0\0\0\0\0\x01\0\0Q\0\0\x0a\0\0\0"}),
    "hwp": lambda: compound.write_hwp(["p"], [[["a", "b"], ["", "c"]]]),
    "txt": lambda: "plain é".encode(),
    "md": lambda: b"# head\n\ntext",
}


def test_every_format_reads(spark):
    rows = [(i, bytearray(make()), f) for i, (f, make) in enumerate(WHOLE.items())]
    found = assembly.documents(spark.createDataFrame(rows, "doc_id bigint, content binary, format string")).collect()
    docs = {list(WHOLE)[r.doc_id]: r.doc for r in found}
    assert [r.error for r in found] == [None] * len(WHOLE)
    assert (docs["pdf"].text, docs["pdf"].title, docs["pdf"].headings[0].text) == ("--- Page 1 ---\n\nsome words", "T", "some words")
    assert docs["doc"].text == "one\n\ntwo" and docs["hwp"].tables[0].markdown.endswith("|  | c |")
    assert (docs["hwpx"].title, docs["hwpx"].text) == ("t", "# x\n\ny") and docs["md"].headings[0].text == "head"


@pytest.mark.parametrize("format", WHOLE)
def test_damaged_files(format):
    rng = random.Random(format)
    whole = WHOLE[format]()
    for _ in range(150):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(1, len(data))] if rng.random() < 0.4 else data)
        try:
            made, _ = assembly.document_from(data, format)
            assert set(made) >= {"text", "pages"}
        except Exception as e:  # one file's failure becomes its row
            assert not isinstance(e, (MemoryError, SystemExit))


def test_damaged_files_leave_the_job_whole(spark):
    rng = random.Random(5)
    rows = []
    for i, (format, make) in enumerate(WHOLE.items()):
        data = bytearray(make())
        data[rng.randrange(len(data))] ^= 255
        rows += [(10 * i, data[: len(data) // 2], format), (10 * i + 1, data, format), (10 * i + 2, None, format), (10 * i + 3, bytearray(make()), format)]
    files_ = spark.createDataFrame(rows, "doc_id bigint, content binary, format string").coalesce(1)
    found = {r.doc_id: r for r in assembly.documents(files_).collect()}
    assert len(found) == len(rows) and all(found[10 * i + 3].error is None for i in range(len(WHOLE)))
    plan = assembly.documents(files_).select("doc.text", "doc.tables", "doc.pages")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


def test_cyclic_and_odd_pdf(spark):
    loop = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[2 0 R 3 0 R]>> endobj\n3 0 obj <</Type/Page/Contents 5 0 R>> endobj\n"
    loop += b"5 0 obj <</Length 60/Filter/FlateDecode/DecodeParms<</Predictor 2/Columns 0>>>> stream\n" + zlib.compress(b"BT (x) Tj ET") + b"\nendstream endobj\n"
    at = len(loop)
    data = loop + b"xref\n0 0\ntrailer <</Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, at)
    assert [r.text for r in pdf.decode(data) if r.kind == "text"] == ["x"]
    newest = pdf.write([[("old", 10, 10)]], packed=False, table=False)
    newest += b"5 0 obj <</Length 34>> stream\nBT /F1 9 Tf 1 1 Td (new) Tj ET     \nendstream endobj\ntrailer <</Root 1 0 R>>"
    assert [r.text for r in pdf.decode(newest) if r.kind == "text"] == ["new"]
    inside = pdf.write([[("1 0 obj <</Type/Nothing>> endobj", 10, 10)]], packed=False, table=False)
    assert [r.kind for r in pdf.decode(inside)].count("page") == 1


def test_forms_and_encodings():
    form = b"<</Subtype/Form/Matrix[1 0 0 1 5 5]/Length 30>> stream\nBT /F1 9 Tf 1 2 Td (in) Tj ET \nendstream"
    page = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R]/Resources<</XObject<</X 6 0 R>>/Font<</F1 7 0 R>>>>>> endobj\n"
    page += b"3 0 obj <</Type/Page/Contents 4 0 R>> endobj 4 0 obj <</Length 42>> stream\n/X Do BT /F1 9 Tf 3 Ts 10 Tc 0 0 Td (A\x80) Tj ET\nendstream endobj\n"
    page += b"6 0 obj " + form + b" endobj 7 0 obj <</Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/uni03B1]>>>> endobj trailer <</Root 1 0 R>>"
    rows = [r for r in pdf.decode(page) if r.kind == "text"]
    assert [(r.text, r.x, r.y) for r in rows] == [("in", 6.0, 7.0), ("α€", 0.0, 3.0)] and rows[1].attrs["char_spacing"] == "10.0"


def test_text_encodings(spark):
    cases = ["한국어 문서".encode("cp949"), b"\xef\xbb\xbfx", "é".encode("utf-16"), b"caf\xe9", "plain".encode(), b"", None]
    want = ["한국어 문서", "x", "é", "café", "plain", "", None]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    assert [r.t for r in rows.select("i", encodings.text_of(F.col("c")).alias("t")).orderBy("i").collect()] == want
    assert encodings.decode("한국어".encode("euc-kr"))[0] == "한국어" and encodings.decode(b"x", "ascii") == ("x", "ascii")


def test_container_formats():
    assert {f: files.container_format(make()) for f, make in WHOLE.items() if f not in ("pdf", "txt", "md")} == {f: f for f in WHOLE if f not in ("pdf", "txt", "md")}
    assert files.container_format(compound.MAGIC + bytes(600)) == "txt"
    assert pagewright.parse_bytes(WHOLE["docx"]())["format"] == "docx" and pagewright.parse_bytes(b"x", "a.markdown")["format"] == "md"
    with pytest.raises(ValueError):
        pagewright.parse_bytes(b"x", "a.zip")


def test_png_and_ppm(tmp_path, spark):
    data = bytes(range(12))
    made = images.png(data, 2, 2, "RGB")
    at = made.index(b"IDAT")
    size = int.from_bytes(made[at - 4 : at], "big")
    assert zlib.decompress(made[at + 4 : at + 4 + size]) == b"\0" + data[:6] + b"\0" + data[6:]
    assert images.ppm(data, 2, 2, "RGB").endswith(data) and images.ppm(b"\x80", 1, 1, "Grayscale", 1).endswith(b"\xff")
    assert images.cmyk_to_rgb(np.array([[0, 0, 0, 0], [255, 0, 0, 0], [0, 0, 0, 255]], np.uint8)).tolist() == [[255, 255, 255], [0, 255, 255], [0, 0, 0]]
    image = b"<</Subtype/Image/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8/Length 12>> stream\n" + data + b"\nendstream"
    whole = pdf.write([[]], extra=[image]).replace(b"/Font<</F1 3 0 R>>", b"/XObject<</I 1000 0 R>>")
    row = next(r for r in pdf.decode(whole) if r.kind == "image")
    assert (row.x2, row.attrs["color_space"], row.data) == (2.0, "RGB", data)
    images.saved(pdf.elements(spark.createDataFrame([(7, bytearray(whole))], "doc_id bigint, content binary")), str(tmp_path))
    assert (tmp_path / "7-1-1.png").read_bytes() == made


def test_tagged_tables():
    names = [b"T", b"a", b"b", b"c"]
    nodes = [b"<</Type/StructTreeRoot/K[1001 0 R]/RoleMap<</Cell/TD>>>>", b"<</S/Table/Pg 4 0 R/K[1002 0 R 1003 0 R]>>", b"<</S/TR/K[<</S/TH/K 0>> <</S/TH/K 1>>]>>", b"<</S/TR/K[<</S/Cell/K<</Type/MCR/MCID 2/Pg 4 0 R>>>>]>>"]
    data = pdf.write([[(n.decode(), 10, 10, i) for i, n in enumerate(names[:3])]], extra=nodes, catalog=b"/StructTreeRoot 1000 0 R")
    rows = list(pdf.decode(data))
    roots = tagged.tree(rows)
    assert tagged.is_tagged(rows) and tagged.tables(roots) == [(0, [["T", "a"], ["b", ""]], True)]
    assert tagged.statistics(roots) == {"Table": 1, "TR": 2, "TH": 2, "TD": 1} and tagged.kind_of("Odd") == "Unknown"
