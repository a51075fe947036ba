import struct
import zlib

from pagewright.sources import compound


def record(kind, body, head=0):
    return struct.pack("<HHI", head, kind, len(body)) + body


def test_streams():
    found = {"a": b"x" * 5000, "b": b"", "c": bytes(range(256)) * 400}
    assert compound.streams(compound.write(found)) == found


def test_slides():
    inner = record(4000, "é title".encode("utf-16-le")) + record(4008, b"body\rtwo")
    rows = list(compound.ppt({"PowerPoint Document": record(1000, inner, 15) + record(4008, b"last")}))
    assert [(r[4], r[6]) for r in rows] == [("é title", 1), ("body\ntwo", 1), ("last", 0)]


def test_hangul():
    text = lambda t: struct.pack("<I", 67 | len(t) << 20) + t
    control = struct.pack("<H", 11) + bytes(14)
    deflate = lambda b: zlib.compress(b)[2:-4]
    body = {f"Section{i}": deflate(text("가 ".encode("utf-16-le") + control + f"{i}\r".encode("utf-16-le"))) for i in range(11)}
    rows = list(compound.hwp({"FileHeader": bytes(36) + struct.pack("<I", 1) + bytes(216)} | body))
    assert [r[4] for r in rows] == [f"가 {i}" for i in range(11)]


def test_numbers():
    packed = lambda x: struct.unpack("<Q", struct.pack("<d", x))[0] >> 32
    assert compound.number(7 << 2 | 2) == 7 and compound.number(((-7) << 2 | 2) & 0xFFFFFFFF) == -7
    assert compound.number(packed(1.5)) == 1.5 and compound.number(1234 << 2 | 3) == 12.34


def test_sheet_with_a_string_over_two_records():
    r = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    shared = r(0xFC, struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 0) + b"ab" + struct.pack("<HB", 4, 0) + b"cd") + r(0x3C, b"\1" + "éf".encode("utf-16-le"))
    sheet = r(0x85, struct.pack("<IHBB", 0, 0, 1, 0) + b"S")
    start = len(shared) + len(sheet)
    sheet = sheet[:4] + struct.pack("<I", start) + sheet[8:]
    cells = r(0x809, b"") + r(0xFD, struct.pack("<HHHI", 0, 0, 0, 1)) + r(0x203, struct.pack("<HHHd", 1, 2, 0, 2.5)) + r(0x0A, b"")
    rows = list(compound.xls({"Workbook": shared + sheet + cells}))
    assert rows == [("sheet", 0, 0, 0, "S", "", 0), ("cell", 0, 1, 1, "cdéf", "", 0), ("cell", 0, 2, 3, "2.5", "", 0)]


def test_broken_files(spark):
    made = spark.createDataFrame([(1, bytearray(b"no")), (2, None), (3, bytearray(compound.write({"x": b"y"})))], "doc_id bigint, content binary")
    assert [r.kind for r in compound.elements(made, "xls").collect()] == ["error"] * 3
