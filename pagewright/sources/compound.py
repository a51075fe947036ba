"""Compound files (doc, xls, ppt, hwp) to the rows of ``ooxml.SCHEMA``, and a small writer.

A file that cannot be read gives a row of kind ``error``, and so does a section of one that can.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from pagewright.sources.decoding import decoded
from pagewright.sources.ooxml import SCHEMA, Row, failed

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_FREE = 0xFFFFFFFA  # from here on sector numbers have other meanings


def _numbers(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))


def _chain(table: list[int], at: int) -> Iterator[int]:
    seen = set()
    while at < len(table) and at not in seen:
        seen.add(at)
        yield at
        at = table[at]


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name; the last of a name counts."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("no compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    first_dir, cutoff, first_mini, _, next_fat, _ = struct.unpack_from("<I4xIIIII", data, 48)
    fat_at, seen = _numbers(data[76:512]), set()
    while next_fat < _FREE and next_fat not in seen:
        seen.add(next_fat)
        *more, next_fat = _numbers(sector(next_fat)) or [_FREE]
        fat_at += more
    fat = [n for i in fat_at if i < _FREE for n in _numbers(sector(i))]
    whole = lambda at: b"".join(map(sector, _chain(fat, at)))
    mini = _numbers(whole(first_mini)) if first_mini < _FREE else []
    listing, found, root = whole(first_dir), {}, b""
    for at in range(0, len(listing) - 127, 128):
        entry = listing[at : at + 128]
        length = max(struct.unpack_from("<H", entry, 64)[0] - 2, 0)
        name, kind = entry[:length].decode("utf-16-le", "replace"), entry[66]
        start, n = struct.unpack_from("<II", entry, 116)
        if kind == 5:
            root = whole(start)
        elif kind == 2:
            tiny = n < cutoff and mini
            found[name] = (b"".join(root[i * small : (i + 1) * small] for i in _chain(mini, start)) if tiny else whole(start))[:n]
    return found


def properties(found: dict[str, bytes]) -> Iterator[Row]:
    """Title and author of the summary property set."""
    data = found.get("\x05SummaryInformation", b"")
    if len(data) < 48:
        return
    base = struct.unpack_from("<I", data, 44)[0]
    places = dict(struct.unpack_from("<II", data, base + 8 + 8 * i) for i in range(min(struct.unpack_from("<I", data, base + 4)[0], 64)))
    page = struct.unpack_from("<H", data, base + places[1] + 4)[0] if 1 in places else 1252
    for number, name in ((2, "title"), (4, "creator")):
        if number in places:
            kind, n = struct.unpack_from("<II", data, base + places[number])
            raw = data[base + places[number] + 8 :][: 2 * n if kind == 0x1F else n]
            coding = "utf-16-le" if kind == 0x1F else {65001: "utf-8", 949: "cp949", 1200: "utf-16-le"}.get(page, "cp1252")
            yield ("property", 0, 0, 0, raw.decode(coding, "replace").rstrip("\0"), name, 0)


#: Magic bytes of images.
IMAGES = {b"\x89PNG": "png", b"\xff\xd8\xff": "jpg", b"GIF8": "gif", b"BM": "bmp", b"II*\0": "tiff", b"MM\0*": "tiff"}


def image_kind(data: bytes) -> str:
    return next((kind for magic, kind in IMAGES.items() if data.startswith(magic)), "")


def _inflated(data: bytes) -> bytes:
    """Deflated bytes without a header, else with one."""
    try:
        return zlib.decompressobj(-15).decompress(data)
    except zlib.error:
        return zlib.decompress(data)


def records(body: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of hwp records."""
    at = 0
    while at + 4 <= len(body):
        word = struct.unpack_from("<I", body, at)[0]
        n, at = word >> 20, at + 4
        if n == 0xFFF:
            n, at = struct.unpack_from("<I", body, at)[0], at + 4
        yield word & 1023, word >> 10 & 1023, body[at : at + n]
        at += n


class _Grid:
    """A hwp table while its records are read: cells by their own addresses, else row after row."""

    def __init__(self, level: int, rows: int, cols: int):
        self.level, self.rows, self.cols, self.cells, self.at = level, rows, cols, {}, None
        self.count = 0

    def cell(self, head: bytes) -> None:
        place = divmod(self.count, self.cols)
        if len(head) >= 16:
            col, row = struct.unpack_from("<HH", head, 8)
            place = (row, col) if row < self.rows and col < self.cols else place
        self.at, self.count = place, self.count + 1
        self.cells.setdefault(place, [])


def hwp(found: dict[str, bytes]) -> Iterator[Row]:
    """Paragraphs, tables by cell, rows of tables as paragraphs of style ``row``, and images."""
    flags = struct.unpack_from("<I", found["FileHeader"], 36)[0]
    if flags & 2:
        raise ValueError("the file is encrypted")
    row = table = 0
    tables: list[_Grid] = []

    def closed(grid: _Grid) -> Iterator[Row]:
        nonlocal row, table
        texts = {p: "\n".join(x) for p, x in grid.cells.items()}
        yield from (("cell", table, r, c, texts.get((r, c), ""), "", 0) for r in range(grid.rows) for c in range(grid.cols))
        table += 1
        for r in range(grid.rows):
            line = " ".join(texts[r, c].strip() for c in range(grid.cols) if texts.get((r, c), "").strip())
            if line and tables:
                tables[-1].cells.setdefault(tables[-1].at, []).append(line)
            elif line:
                yield ("paragraph", 0, row, 0, line, "row", 0)
                row += 1

    sections = sorted((n for n in found if re.fullmatch(r"Section\d+", n)), key=lambda n: int(n[7:])) or sorted(n for n in found if n.startswith("Section"))
    for name in sections:
        try:
            body = _inflated(found[name]) if flags & 1 else found[name]
        except zlib.error as e:
            yield failed(f"{name}: {e}")
            continue
        for tag, level, payload in records(body):
            while tables and level < tables[-1].level:
                yield from closed(tables.pop())
            if tag == 77 and len(payload) >= 8:  # 77: a table, 72: the head of a cell's list, 67: the text of a paragraph
                rows, cols = struct.unpack_from("<HH", payload, 4)
                if 0 < rows <= 500 and 0 < cols <= 100:
                    tables.append(_Grid(level, rows, cols))
            elif tag == 72 and tables and level == tables[-1].level:
                tables[-1].cell(payload)
            elif tag == 67 and (text := hwp_text(payload)):
                if tables and tables[-1].at is not None:
                    tables[-1].cells[tables[-1].at].append(text)
                else:
                    yield ("paragraph", 0, row, 0, text, "", 0)
                    row += 1
        while tables:
            yield from closed(tables.pop())
    yield from properties({"\x05SummaryInformation": found.get("\x05HwpSummaryInformation", b"")})
    for i, name in enumerate(sorted(n for n in found if n.upper().startswith("BIN") and found[n])):
        data = found[name]
        if not image_kind(data):
            try:
                data = _inflated(data)
            except zlib.error:
                continue
        kind = image_kind(data) or (name.rsplit(".", 1)[-1].lower() if "." in name else "")
        if kind:
            yield ("image", i, 0, 0, name, kind, len(data), data)


#: Control characters of doc texts: what becomes of them; others go.
_DOC = {7: "\t", 9: "\t", 10: "\n", 11: "\n", 12: "\n", 14: "\n", 13: "\r"} | {i: None for i in (*range(7), 8, *range(15, 32))}


def _pieces(word: bytes, table: bytes) -> str:
    """The text by the piece table: runs in UTF-16 or single bytes."""
    count, at, n = struct.unpack_from("<I", word, 0x4C)[0], *struct.unpack_from("<II", word, 0x1A2)
    clx, place = table[at : at + n], 0
    while place < len(clx) and clx[place] == 1:
        place += 3 + struct.unpack_from("<H", clx, place + 1)[0]
    if place >= len(clx) or clx[place] != 2:
        raise ValueError("no piece table")
    plc = clx[place + 5 : place + 5 + struct.unpack_from("<I", clx, place + 1)[0]]
    many = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{many + 1}I", plc)
    out = []
    for i in range(many):
        start, chars = struct.unpack_from("<I", plc, 4 * (many + 1) + 8 * i + 2)[0], max(min(ends[i + 1], count) - ends[i], 0)
        single = start & 0x40000000
        start = (start & 0x3FFFFFFF) // (2 if single else 1)
        raw = word[start : start + chars * (1 if single else 2)]
        out.append(raw.decode("cp1252" if single else "utf-16-le", "replace"))
    return "".join(out)


def _scanned(word: bytes) -> str:
    """Text where the piece table is of no use: from 0x200 on as UTF-16, single bytes or Korean."""
    for coding in ("utf-16-le", "cp1252", "cp949"):
        text = word[0x200:].decode(coding, "ignore").translate(_DOC)
        if len(text) > 100 and sum(c.isalnum() or c.isspace() for c in text) > 0.7 * len(text):
            return text
    return ""


def doc(found: dict[str, bytes]) -> Iterator[Row]:
    """The paragraphs of a doc file (O14), its title and author."""
    word = found["WordDocument"]
    magic, flags = struct.unpack_from("<H8xH", word)
    if magic != 0xA5EC:
        raise ValueError("no doc file")
    if flags & 0x100:
        raise ValueError("the file is encrypted")
    try:
        text = _pieces(word, found["1Table" if flags & 0x200 else "0Table"]).translate(_DOC)
    except (struct.error, KeyError, ValueError):
        text = _scanned(word)
    own = (x.strip() for x in text.split("\r"))
    yield from (("paragraph", 0, i, 0, x, "", 0) for i, x in enumerate(x for x in own if x))
    yield from properties(found)


def hwp_text(data: bytes) -> str:
    """UTF-16 text without its control characters, most of which carry 14 bytes more."""
    out, at = bytearray(), 0
    while at + 2 <= len(data):
        code = struct.unpack_from("<H", data, at)[0]
        if code >= 32:
            out += data[at : at + 2]
        elif code in (9, 10, 13):
            out += ("\t" if code == 9 else "\n").encode("utf-16-le")
        at += 2 if code >= 32 or code in (0, 10, 13, *range(24, 32)) else 16
    return out.decode("utf-16-le", "replace").strip()


#: Texts of a binary slide after which the next one begins, and the length under which its first text is the title.
SLIDE_TEXTS, TITLE_CHARS = 10, 100


def slides(texts: list[str]) -> list[tuple[str, list[str]]]:
    """(title, texts) of the slides that a run of texts makes."""
    made: list[tuple[str, list[str]]] = []
    for text in texts:
        if not made or len(made[-1][1]) + bool(made[-1][0]) > SLIDE_TEXTS:
            made.append((text, []) if len(text) < TITLE_CHARS else ("", [text]))
        else:
            made[-1][1].append(text)
    return made


def _pictures(data: bytes) -> Iterator[Row]:
    """Images of the picture stream, from their magic bytes on."""
    at = number = 0
    while at + 8 <= len(data):
        _, kind, n = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + n]
        starts = [p for magic in (b"\x89PNG", b"\xff\xd8\xff") if (p := body.find(magic, 0, 128)) >= 0]
        if 0xF018 <= kind <= 0xF117 and starts:
            image = body[min(starts) :]
            yield ("image", number, 0, 0, f"image{number + 1}.{image_kind(image)}", image_kind(image), len(image), image)
            number += 1
        at += 8 + n


def ppt(found: dict[str, bytes]) -> Iterator[Row]:
    """The texts of all records in order, containers opened; pictures, title and author."""
    yield from _texts(found["PowerPoint Document"])
    yield from _pictures(found.get("Pictures", b""))
    yield from properties(found)


def _texts(data: bytes) -> Iterator[Row]:
    row, ends, at = 0, [], 0
    while at + 8 <= len(data):
        ends = [e for e in ends if e > at]
        head, kind, n = struct.unpack_from("<HHI", data, at)
        at += 8
        if head & 15 == 15:
            ends.append(at + n)
            continue
        if kind in (4000, 4008, 4026):  # texts in UTF-16, in single bytes, and names in UTF-16
            text = data[at : at + n].decode("cp1252" if kind == 4008 else "utf-16-le", "replace").replace("\r", "\n").replace("\x0b", "\n").strip()
            if text:
                yield ("shape", 0, row, 0, text, "", len(ends))
                row += 1
        at += n


def number(rk: int) -> float:
    """The value of a packed number: 30 bits of an integer or the high bits of a double, perhaps in hundredths."""
    signed = rk - (1 << 32) if rk >> 31 else rk
    value = float(signed >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & ~3) << 32))[0]
    return value / 100 if rk & 1 else value


def _strings(parts: list[bytes]) -> list[str]:
    """The shared strings; a string cut between two records starts the second with its own width."""
    part, at, out = 0, 8, []
    total = struct.unpack_from("<I", parts[0], 4)[0]
    while len(out) < total and part < len(parts):
        if at >= len(parts[part]):
            part, at = part + 1, 0
            continue
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        skip = 0
        if flags & 8:
            skip, at = 4 * struct.unpack_from("<H", parts[part], at)[0], at + 2
        if flags & 4:
            skip, at = skip + struct.unpack_from("<I", parts[part], at)[0], at + 4
        text = ""
        while n and part < len(parts):
            wide = 1 + (flags & 1)
            piece = parts[part][at : at + n * wide]
            text += piece.decode("utf-16-le" if wide == 2 else "latin-1", "replace")
            n, at = n - len(piece) // wide, at + len(piece)
            if n:
                part, at = part + 1, 1
                flags = parts[part][0] if part < len(parts) and parts[part] else flags
        while skip and part < len(parts):
            step = min(skip, len(parts[part]) - at)
            skip, at = skip - step, at + step
            if skip:
                part, at = part + 1, 0
        out.append(text)
    return out


def _result(body: bytes) -> str | None:
    """The value of a formula's record; None where a record of its own has the text."""
    if body[12:14] != b"\xff\xff":
        return str(struct.unpack_from("<d", body, 6)[0])
    return {1: str(bool(body[8])), 2: "#ERR", 3: ""}.get(body[6])


def xls(found: dict[str, bytes]) -> Iterator[Row]:
    """Sheets and their cells, rows and columns from 1; shared strings are resolved in the workbook itself."""
    data, listed, at = found.get("Workbook") or found["Book"], [], 0
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        listed.append((kind, at, data[at + 4 : at + 4 + n]))
        at += 4 + n
    shared, sheets = [], []
    for i, (kind, _, body) in enumerate(listed):
        if kind == 0xFC:
            end = next((j for j in range(i + 1, len(listed)) if listed[j][0] != 0x3C), len(listed))
            shared = _strings([r[2] for r in listed[i:end]])
        elif kind == 0x85:
            offset, n, flags = struct.unpack_from("<IxxBB", body)
            sheets.append((offset, body[8 : 8 + n * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1")))
    yield from properties(found)
    place = {at: i for i, (_, at, _) in enumerate(listed)}
    for part, (offset, name) in enumerate(sheets):
        yield ("sheet", part, 0, 0, name, "", 0)
        waiting = None
        for kind, _, body in listed[place.get(offset, len(listed)) :]:
            if kind == 0x0A:
                break
            if kind == 0x207 and waiting is not None:  # the text of the formula before
                n, wide = struct.unpack_from("<HB", body)
                yield ("cell", part, waiting[0] + 1, waiting[1] + 1, body[3 : 3 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace"), "", 0)
                waiting = None
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x205):
                continue
            row, col = struct.unpack_from("<HH", body)
            if kind == 0x06:
                value = _result(body)
                waiting = (row, col) if value is None else None
                if value is not None:
                    yield ("cell", part, row + 1, col + 1, value, "", 0)
                continue
            if kind == 0x205:
                yield ("cell", part, row + 1, col + 1, "#ERR" if body[7] else str(bool(body[6])), "", 0)
                continue
            if kind == 0xBD:  # several packed numbers
                values = [str(number(struct.unpack_from("<I", body, p)[0])) for p in range(6, len(body) - 5, 6)]
            elif kind == 0xFD:
                index = struct.unpack_from("<I", body, 6)[0]
                values = [shared[index] if index < len(shared) else ""]
            elif kind == 0x204:
                n, wide = struct.unpack_from("<HB", body, 6)
                values = [body[9 : 9 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1")]
            else:
                values = [str(struct.unpack_from("<d", body, 6)[0] if kind == 0x203 else number(struct.unpack_from("<I", body, 6)[0]))]
            for i, value in enumerate(values):
                yield ("cell", part, row + 1, col + 1 + i, value, "", 0)


DECODERS = {"doc": doc, "xls": xls, "ppt": ppt, "hwp": hwp}


def rows(content: bytes | None, format: str) -> Iterator[Row]:
    for row in DECODERS[format](streams(content or b"")):
        yield row if len(row) == 8 else (*row, None)


def elements(files: DataFrame, format: str) -> DataFrame:
    """Rows of the files' elements; ``files`` has doc_id and content."""
    return decoded(files, SCHEMA, lambda content: rows(content, format), failed)


def write(found: dict[str, bytes]) -> bytes:
    """A compound file with its streams in plain sectors."""
    sectors, fat, entries = [], [], [("Root Entry", 5, _FREE + 4, 0)]

    def put(data: bytes) -> int:
        start, n = len(sectors), max(1, -(-len(data) // 512))
        sectors.extend(data[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(start + 1, start + n), _FREE + 4])
        return start

    for name, data in found.items():
        entries.append((name, 2, put(data), len(data)))
    listing = b"".join(
        n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB12s36xIII", 2 * len(n) + 2, kind, 1, b"\xff" * 12, start, size, 0) for n, kind, start, size in entries
    )
    first_dir = put(listing)
    own = -(-(len(fat) + 1) // 127)
    at = list(range(len(sectors), len(sectors) + own))
    fat += [_FREE + 3] * own
    sectors += [struct.pack("<128I", *(fat[i * 128 : (i + 1) * 128] + [_FREE + 5] * 128)[:128]) for i in range(own)]
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", own, first_dir, 0, 0, _FREE + 4, 0, _FREE + 4, 0)
    return head + struct.pack("<109I", *(at + [_FREE + 5] * 109)[:109]) + b"".join(sectors)


def write_doc(paragraphs: list[str]) -> bytes:
    """A doc file with its text in one piece, in UTF-16."""
    text = "".join(f"{p}\r" for p in paragraphs)
    plc = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400, 0)
    clx = struct.pack("<BI", 2, len(plc)) + plc
    head = bytearray(0x400)
    struct.pack_into("<H", head, 0, 0xA5EC)
    struct.pack_into("<H", head, 10, 0x200)
    struct.pack_into("<I", head, 0x4C, len(text))
    struct.pack_into("<II", head, 0x1A2, 0, len(clx))
    return write({"WordDocument": bytes(head) + text.encode("utf-16-le"), "1Table": clx})


def write_hwp(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    """A hwp file of one deflated section: paragraphs, then tables with their cells' addresses."""

    def record(tag: int, level: int, body: bytes) -> bytes:
        long = len(body) >= 0xFFF
        return struct.pack("<I", tag | level << 10 | (0xFFF if long else len(body)) << 20) + (struct.pack("<I", len(body)) if long else b"") + body

    body = b"".join(record(67, 1, p.encode("utf-16-le")) for p in paragraphs)
    for grid in tables:
        body += record(77, 2, struct.pack("<IHH", 0, len(grid), len(grid[0])))
        for r, row in enumerate(grid):
            for c, text in enumerate(row):
                if text:
                    body += record(72, 2, struct.pack("<HIHHHHH", 1, 0, 0, c, r, 1, 1)) + record(67, 3, text.encode("utf-16-le"))
    packed = zlib.compressobj(wbits=-15)
    head = b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", 1) + bytes(216)
    return write({"FileHeader": head, "Section0": packed.compress(body) + packed.flush()})
