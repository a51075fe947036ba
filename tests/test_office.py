"""What office files hold beside plain text: types, formulas, images, properties, lists, slides."""

import struct
import zlib

from pagewright.functions import textops
from pagewright.operators import assembly
from pagewright.sources import compound, ooxml
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\nrest"


def decoded(content, format):
    return list((ooxml if format in ooxml.DECODERS else compound).rows(content, format))


def test_cells_of_every_type(spark):
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>9</v></c><c r="C1" t="b"><v>1</v></c><c r="D1"><v>12</v></c><c r="E1"><v>1.50</v></c><c r="F1"><v>1E5</v></c>'
    cells += '<c r="G1" t="inlineStr"><is><t>in</t></is></c><c r="H1"><f>A1+1</f><v>2</v></c><c><v>lost</v></c><c r="AA2" t="e"><v>#DIV/0!</v></c>'
    parts = {
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="one" r:id="x"/><sheet name="two" r:id="y"/><sheet name="gone" r:id="z"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<r><R Id="x" Target="worksheets/sheet7.xml"/><R Id="y" Target="/xl/bad.xml"/></r>',
        "xl/sharedStrings.xml": "<sst><si><t>sh</t><r><t>ared</t></r></si></sst>", "xl/worksheets/sheet7.xml": f"<s>{cells}</s>", "xl/bad.xml": "<s><c r='A1'>",
    }
    data = ooxml._zipped(parts)
    rows = decoded(data, "xlsx")
    assert [r[4] for r in rows if r[0] == "cell"] == ["shared", "9", "True", "12", "1.5", "100000.0", "in", "2", "#DIV/0!"]
    assert [(r[2], r[3], r[4]) for r in rows if r[0] == "formula"] == [(1, 8, "A1+1")] and [r[0] for r in rows].count("error") == 1
    found = ooxml.elements(spark.createDataFrame([(1, bytearray(data))], "doc_id bigint, content binary"), "xlsx")
    assert ooxml.sheet(found, "one").count() == 9 and ooxml.sheet(found, 1).count() == 0
    assert [r.text for r in ooxml.cell(found, "one", 2, 27).collect()] == ["#DIV/0!"]
    doc, wrong = assembly.document_from(data, "xlsx")
    assert [t["name"] for t in doc["tables"]] == ["one"] and "bad.xml" in wrong


def test_lists_images_and_properties():
    core = "<c xmlns:d='d'><d:title>T</d:title><d:creator>C</d:creator><d:created>2020</d:created></c>"
    body = '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
    data = ooxml._zipped({"word/document.xml": f'<w:d xmlns:w="w"><w:body>{body}</w:body></w:d>', "word/media/i.png": PNG, "docProps/core.xml": core})
    rows = decoded(data, "docx")
    assert next(r[3] for r in rows if r[0] == "paragraph") == 2 and {r[5]: r[4] for r in rows if r[0] == "property"}["created"] == "2020"
    doc, _ = assembly.document_from(data, "docx")
    assert (doc["title"], doc["author"]) == ("T", "C") and doc["images"] == [{"page": 1, "filename": "i.png", "format": "png", "data": PNG}]


def test_presentation_tables_and_notes():
    table = "<a:tbl><a:tr><a:tc><a:t>h</a:t></a:tc></a:tr><a:tr><a:tc><a:t>v</a:t></a:tc></a:tr></a:tbl>"
    data = ooxml._zipped({"ppt/slides/slide10.xml": f'<s xmlns:a="a"><sp><a:t>first line of it</a:t></sp>{table}</s>', "ppt/slides/slide2.xml": "<s><broken", "ppt/notesSlides/notesSlide10.xml": '<n xmlns:a="a"><a:t>note</a:t></n>'})
    doc, wrong = assembly.document_from(data, "pptx")
    assert [p["page"] for p in doc["pages"]] == [1, 2] and doc["pages"][1]["tables"][0]["markdown"] == "| h |\n| --- |\n| v |"
    assert "slide2.xml" in wrong and doc["headings"] == [{"level": 1, "text": "first line of it"}]
    assert [r[4] for r in decoded(data, "pptx") if r[0] == "note"] == ["note"]


def test_hwpx_tables_and_breaks():
    cell = lambda t: f"<h:tc><h:p><h:t>{t}</h:t></h:p></h:tc>"
    table = f"<h:tbl><h:tr>{cell('a')}{cell('b')}</h:tr><h:tr>{cell('')}{cell('d')}</h:tr></h:tbl>"
    body = f"<s xmlns:h='h'><h:p><h:run>{table}<h:t>after<h:lineBreak/>it</h:t></h:run></h:p><h:p><h:t>after</h:t></h:p><h:p><h:run><h:tbl><h:tr>{cell('alone')}</h:tr></h:tbl></h:run></h:p></s>"
    doc, _ = assembly.document_from(ooxml._zipped({"Contents/section0.xml": body, "BinData/x.png": PNG}), "hwpx")
    assert doc["text"] == "a b\n\nd\n\nafterit\n\nafter\n\nalone" and len(doc["tables"]) == 1 and doc["images"][0]["data"] == PNG


def summary(title, author):
    text = lambda t: struct.pack("<II", 0x1E, len(t) + 1) + t + b"\0" * (4 - len(t) % 4)
    one, two = text(title), text(author)
    body = struct.pack("<II", 0, 2) + struct.pack("<IIII", 2, 24, 4, 24 + len(one)) + one + two
    return bytes(28) + bytes(16) + struct.pack("<I", 48) + body


def test_properties_and_pictures_of_compound_files():
    picture = struct.pack("<HHI", 0x6E0, 0xF01E, 17 + len(PNG)) + bytes(17) + PNG
    text = "short".encode("utf-16-le")
    data = compound.write({"PowerPoint Document": struct.pack("<HHI", 0, 4026, len(text)) + text, "Pictures": picture, "\x05SummaryInformation": summary(b"T", b"Me")})
    doc, _ = assembly.document_from(data, "ppt")
    assert (doc["title"], doc["author"], doc["images"][0]["data"], doc["text"]) == ("T", "Me", PNG, "=== 슬라이드 1 ===\nshort")
    packed = zlib.compressobj(wbits=-15)
    whole = compound.streams(compound.write_hwp(["p"])) | {"BIN0001.png": packed.compress(PNG) + packed.flush()}
    doc, _ = assembly.document_from(compound.write(whole), "hwp")
    assert doc["images"][0] | {"page": 1} == {"page": 1, "filename": "BIN0001.png", "format": "png", "data": PNG}


def test_slides_of_binary_presentations():
    made = compound.slides([f"t{i}" for i in range(12)] + ["x" * 150])
    assert [(t, len(x)) for t, x in made] == [("t0", 10), ("t11", 1)]
    assert compound.slides(["y" * 100]) == [("", ["y" * 100])]


def test_formulas_and_errors_of_xls():
    cell = lambda kind, row, col, body: struct.pack("<HHHHH", kind, 6 + len(body), row, col, 0) + body
    text = struct.pack("<HHHB", 0x207, 5, 2, 0) + b"ok"
    cells = cell(6, 0, 0, struct.pack("<d", 2.5) + bytes(8)) + cell(6, 0, 1, b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + text
    cells += cell(6, 0, 2, b"\1\0\1\0\0\0\xff\xff" + bytes(8)) + cell(0x205, 0, 3, b"\x07\1") + struct.pack("<HH", 10, 0)
    sheet = struct.pack("<HHIHBB", 0x85, 9, 17, 0, 1, 0) + b"S"
    sheet = struct.pack("<HHIHBB", 0x85, 9, len(sheet), 0, 1, 0) + b"S"
    rows = list(compound.xls({"Workbook": sheet + cells}))
    assert [(r[3], r[4]) for r in rows if r[0] == "cell"] == [(1, "2.5"), (2, "ok"), (3, "True"), (4, "#ERR")]


def test_doc_without_a_piece_table():
    word = bytearray(0x200)
    struct.pack_into("<H", word, 0, 0xA5EC)
    text = "A paragraph of plain words that is long enough to be taken as text.\rAnd another one that follows it here."
    doc, _ = assembly.document_from(compound.write({"WordDocument": bytes(word) + text.encode("utf-16-le")}), "doc")
    assert doc["text"].split("\n\n") == text.split("\r")


def test_markdown_documents(spark):
    text = "# a\r\n```py\nx\n```\n[l](u) ![i](j) z\n"
    made = spark.range(1).select(textops.markdown_document(F.lit(text)).alias("d")).first().d
    assert made.lines == text.splitlines() and made.headings[0].level == 1 and made.code_blocks[0].lang == "py"
    assert (made.links[0].url, made.images[0].alt) == ("u", "i")
