"""ZIP and XML documents (xlsx, docx, pptx, hwpx) to rows, and writers of small ones.

``elements`` is the one boundary where opaque bytes become rows (doc_id, kind, part, row, col, text, style, level,
data); shared strings and styles are resolved there, so nothing is decoded twice.  A file that cannot be read gives a row of
kind ``error``, and so does a member of one that can; the rest of the file stands.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.decoding import decoded

SCHEMA = "doc_id bigint, kind string, part int, row int, col int, text string, style string, level int, data binary"
Row = tuple  # (kind, part, row, col, text, style, level[, data])


def failed(reason: str) -> Row:
    return ("error", 0, 0, 0, reason, "", 0, None)


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _tag(x) == name)


def _text(e: ET.Element, name: str = "t", between: str = "") -> str:
    return between.join(x.text or "" for x in _all(e, name))


def _value(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _numbered(names: list[str], pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n)))


def _member(name: str, rows: Callable[[], Iterator[Row]]) -> Iterator[Row]:
    """The rows of a member; what is wrong with it is its own error row."""
    try:
        yield from rows()
    except Exception as e:
        yield failed(f"{name}: {type(e).__name__}: {e}")


def _properties(z: zipfile.ZipFile) -> Iterator[Row]:
    """Title, creator and dates."""
    if "docProps/core.xml" in z.namelist():
        for e in ET.fromstring(z.read("docProps/core.xml")):
            yield ("property", 0, 0, 0, e.text or "", _tag(e), 0)


def _media(z: zipfile.ZipFile) -> Iterator[Row]:
    """Image members with their bytes."""
    for i, n in enumerate(n for n in z.namelist() if ("/media/" in n or "bindata/" in n.lower()) and not n.endswith("/")):
        yield from _member(n, lambda i=i, n=n: iter([("image", i, 0, 0, n, "", z.getinfo(n).file_size, z.read(n))]))


def _table(e: ET.Element, number: int, row: str, cell: str, text: Callable[[ET.Element], str] = lambda c: _text(c, between=" ")) -> Iterator[Row]:
    for r, tr in enumerate(_all(e, row)):
        for c, tc in enumerate(_all(tr, cell)):
            yield ("cell", number, r, c, text(tc), "", 0)


def number_text(raw: str) -> str:
    """A number of a sheet as text: a float with its point, an integer without (X20); what is no number stays."""
    try:
        return repr(float(raw)) if re.search(r"[.eE]", raw) else str(int(raw))
    except ValueError:
        return raw


def _cells(sheet: ET.Element, part: int, strings: list[str]) -> Iterator[Row]:
    """Cells with their shown text, their raw type in ``style``, and formulas as their own rows."""
    for cell in _all(sheet, "c"):
        m = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
        if not m:
            continue
        col = 0
        for letter in m[1]:
            col = col * 26 + ord(letter) - 64
        kind = cell.get("t", "n")
        raw = next((v.text or "" for v in cell if _tag(v) == "v"), "")
        if kind == "inlineStr":
            shown = _text(cell)
        elif kind == "s":
            shown = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else raw
        else:
            shown = {"1": "True"}.get(raw, "False") if kind == "b" else number_text(raw) if kind in ("n", "") else raw
        yield ("cell", part, int(m[2]), col, shown, kind, 0)
        formula = next((f.text for f in cell if _tag(f) == "f" and f.text), None)
        if formula:
            yield ("formula", part, int(m[2]), col, formula, kind, 0)


def xlsx(z: zipfile.ZipFile) -> Iterator[Row]:
    """Sheets by their relationships, else by number, and their cells."""
    names, strings, targets = set(z.namelist()), [], {}
    errors: list[Row] = []
    try:
        if "xl/sharedStrings.xml" in names:
            strings = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {x.get("Id"): x.get("Target", "") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        listed = [(s.get("name", ""), _value(s, "id")) for s in _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet")]
    except Exception as e:
        errors.append(failed(f"xl/workbook.xml: {type(e).__name__}: {e}"))
        listed = [(f"Sheet{i}", "") for i, _ in _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml")]
    yield from errors
    for i, (name, rel) in enumerate(listed):
        target = targets.get(rel, f"worksheets/sheet{i + 1}.xml")
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if member not in names:
            continue
        yield ("sheet", i, 0, 0, name, "", 0)
        yield from _member(member, lambda i=i, member=member: _cells(ET.fromstring(z.read(member)), i, strings))
    yield from _member("docProps/core.xml", lambda: _properties(z))


def _styles(z: zipfile.ZipFile) -> dict[str, int]:
    """Heading levels by style id: the number in a heading's name, else the outline level."""
    levels = {}
    for s in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
        outline = next((int(_value(x, "val")) + 1 for x in _all(s, "outlineLvl") if _value(x, "val").isdigit()), 0)
        named = next((m for x in _all(s, "name") if (m := re.match(r"[Hh]eading\s*(\d)", _value(x, "val")))), None)
        levels[_value(s, "styleId")] = int(named[1]) if named else outline
    return levels


def docx(z: zipfile.ZipFile) -> Iterator[Row]:
    """Body paragraphs with style and heading level (``col`` is 1 plus a list item's level), and tables by cell."""
    levels: dict[str, int] = {}
    if "word/styles.xml" in z.namelist():
        try:
            levels = _styles(z)
        except Exception as e:
            yield failed(f"word/styles.xml: {type(e).__name__}: {e}")

    def body() -> Iterator[Row]:
        paragraph = table = 0
        for e in next(_all(ET.fromstring(z.read("word/document.xml")), "body"), ()):
            if _tag(e) == "p":
                style = next((_value(x, "val") for x in _all(e, "pStyle")), "")
                own = re.match(r"[Hh]eading.*?(\d)", style)
                item = next((_value(x, "val") for x in _all(e, "ilvl")), "0" if next(_all(e, "numPr"), None) is not None else "")
                yield ("paragraph", 0, paragraph, 1 + int(item) if item.isdigit() else 0, _text(e), style, int(own[1]) if own else levels.get(style, 0))
                paragraph += 1
            elif _tag(e) == "tbl":
                yield from _table(e, table, "tr", "tc")
                table += 1

    yield from _member("word/document.xml", body)
    yield from _media(z)
    yield from _member("docProps/core.xml", lambda: _properties(z))


def pptx(z: zipfile.ZipFile) -> Iterator[Row]:
    """Shapes of each slide in order, title placeholders marked, tables by cell with their slide in ``level``, notes."""
    table = 0
    for i, (number, name) in enumerate(_numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")):
        yield ("slide", i, number, 0, name, "", 0)
        try:
            root = ET.fromstring(z.read(name))
            for k, sp in enumerate(_all(root, "sp")):
                kinds = {_value(x, "type") for x in _all(sp, "ph")}
                if text := _text(sp):
                    yield ("shape", i, k, 0, text, "title" if kinds & {"title", "ctrTitle"} else "", 0)
            for t in _all(root, "tbl"):
                yield from ((*c[:6], i) for c in _table(t, table, "tr", "tc"))
                table += 1
            if (note := f"ppt/notesSlides/notesSlide{number}.xml") in z.namelist():
                yield ("note", i, 0, 0, _text(ET.fromstring(z.read(note))), "", 0)
        except Exception as e:
            yield failed(f"{name}: {type(e).__name__}: {e}")
    yield from _media(z)
    yield from _member("docProps/core.xml", lambda: _properties(z))


def _outside(e: ET.Element) -> str:
    """The text of a hwpx element without its tables; line breaks give way to what follows them."""
    if _tag(e) == "tbl":
        return ""
    own = (e.text or "") if _tag(e) in ("t", "char") else ""
    return own + "".join(_outside(x) + ((x.tail or "") if _tag(x) == "lineBreak" or _tag(e) == "t" else "") for x in e)


def _outermost(e: ET.Element) -> Iterator[ET.Element]:
    for x in e:
        if _tag(x) == "tbl":
            yield x
        else:
            yield from _outermost(x)


def _outline(e: ET.Element) -> int:
    """A paragraph's heading level by any attribute that names a level of 0 to 9."""
    for x in (e, *(c for c in e if _tag(c) != "tbl")):
        for k, v in x.attrib.items():
            if "level" in k.rsplit("}", 1)[-1].lower() and re.fullmatch(r"\d", v):
                return int(v) + 1
    return 0


def hwpx(z: zipfile.ZipFile) -> Iterator[Row]:
    """Sections in numeric order: tables by cell, the rows of tables as paragraphs of style ``row``, and paragraphs.

    A paragraph whose trimmed text has come before has ``col`` 1 (X23), a blank one 2.
    """
    seen: set[str] = set()
    counts = {"paragraph": 0, "table": 0}

    def paragraph(text: str, style: str, level: int) -> Row:
        key = text.strip()
        row = ("paragraph", 0, counts["paragraph"], 2 if not key else int(key in seen), text, style, level)
        seen.add(key)
        counts["paragraph"] += 1
        return row

    def section(name: str) -> Iterator[Row]:
        for p in (x for x in ET.fromstring(z.read(name)) if _tag(x) == "p"):
            for t in _outermost(p):
                cells = list(_table(t, counts["table"], "tr", "tc", lambda c: " ".join(x for x in (_text(c, between=" "),) if x)))
                counts["table"] += 1
                yield from cells
                for r in sorted({c[2] for c in cells}):
                    line = " ".join(c[4].strip() for c in cells if c[2] == r and c[4].strip())
                    if line:
                        yield paragraph(line, "row", 0)
            yield paragraph(_outside(p), "", _outline(p))

    for _, name in _numbered(z.namelist(), r"Contents/section(\d+)\.xml"):
        yield from _member(name, lambda name=name: section(name))
    yield from _media(z)
    if "Contents/content.hpf" in z.namelist():  # the last of each name counts (X31)

        def metadata() -> Iterator[Row]:
            found = {_tag(e): e.text or "" for e in ET.fromstring(z.read("Contents/content.hpf")).iter() if _tag(e) in ("title", "creator", "date")}
            return (("property", 0, 0, 0, text, name, 0) for name, text in found.items())

        yield from _member("Contents/content.hpf", metadata)


DECODERS = {"xlsx": xlsx, "docx": docx, "pptx": pptx, "hwpx": hwpx}


def rows(content: bytes | None, format: str) -> Iterator[Row]:
    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
        for row in DECODERS[format](z):
            yield row if len(row) == 8 else (*row, None)


def elements(files: DataFrame, format: str) -> DataFrame:
    """Rows of the files' elements; ``files`` has doc_id and content."""
    return decoded(files, SCHEMA, lambda content: rows(content, format), failed)


def sheet_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, part, row, col, text) of the cells of workbooks, as shown."""
    return rows.where("kind = 'cell'").select("doc_id", "part", "row", "col", "text")


def sheet(rows: DataFrame, which: str | int) -> DataFrame:
    """The cells of one sheet of each workbook, by name or by place from 0."""
    if isinstance(which, int):
        return sheet_cells(rows).where(F.col("part") == which)
    named = F.max(F.when((F.col("kind") == "sheet") & (F.col("text") == which), F.col("part"))).over(Window.partitionBy("doc_id"))
    return sheet_cells(rows.withColumn("wanted", named).where("part = wanted"))


def cell(rows: DataFrame, which: str | int, row: int, col: int) -> DataFrame:
    """(doc_id, text) of one cell of a sheet, rows and columns from 1; missing cells give no row."""
    return sheet(rows, which).where((F.col("row") == row) & (F.col("col") == col)).select("doc_id", "text")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, text, heading_level) of paragraphs (X6); repeats within a hwpx document are left out."""
    own = rows.where("kind = 'paragraph'")
    return own.select("doc_id", F.col("row").alias("seq"), "text", F.col("level").alias("heading_level"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def write_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook with every string shared."""
    strings: dict[str, int] = {}
    parts = {"xl/workbook.xml": "<workbook><sheets>" + "".join(f'<sheet name="{escape(n)}"/>' for n in sheets) + "</sheets></workbook>"}
    for i, grid in enumerate(sheets.values()):
        rows = []
        for r, row in enumerate(grid, 1):
            cells = "".join(f'<c r="{chr(65 + c)}{r}" t="s"><v>{strings.setdefault(x, len(strings))}</v></c>' for c, x in enumerate(row))
            rows.append(f'<row r="{r}">{cells}</row>')
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>"
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in strings) + "</sst>"
    return _zipped(parts)


def write_docx(items: list[tuple[str, str]]) -> bytes:
    """Paragraphs of (style, text)."""
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{escape(t)}</w:t></w:r></w:p>' for s, t in items)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{p}</w:body></w:document>'})


def write_pptx(slides: list[tuple[str, str]]) -> bytes:
    """A slide for each (title, text)."""
    parts = {}
    for i, (title, text) in enumerate(slides, 1):
        head = f'<p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:t>{escape(title)}</a:t></p:sp>'
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a">{head}<p:sp><a:t>{escape(text)}</a:t></p:sp></p:sld>'
    return _zipped(parts)


def write_hwpx(items: list[str | tuple[str, int]], meta: dict[str, str] | None = None) -> bytes:
    """One section a paragraph, which shows the numeric order of sections; (text, level) is a heading from level 1 on."""
    parts = {}
    for i, item in enumerate(items):
        text, level = item if isinstance(item, tuple) else (item, 0)
        mark = f' outlineLevel="{level - 1}"' if level else ""
        parts[f"Contents/section{i}.xml"] = f'<s xmlns:h="h"><h:p{mark}><h:t>{escape(text)}</h:t></h:p></s>'
    if meta:
        parts["Contents/content.hpf"] = "<package>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in meta.items()) + "</package>"
    return _zipped(parts)
