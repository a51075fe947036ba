"""The document result as one struct, and its Markdown, JSON and text renderings, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import render, textops

_TABLE = "struct<page:int,name:string,rows:int,cols:int,markdown:string>"
_IMAGE = "struct<page:int,filename:string,format:string,data:binary>"
#: Every format fills the same fields; what a format lacks is empty.
FIELDS = {
    "filename": "string", "format": "string", "page_count": "int", "title": "string", "author": "string", "text": "string",
    "headings": "array<struct<level:int,text:string>>", "pages": f"array<struct<page:int,name:string,text:string,tables:array<{_TABLE}>>>",
    "tables": f"array<{_TABLE}>", "images": f"array<{_IMAGE}>",
}
#: The labels of the Markdown rendering.
INFO, AUTHOR, FORMAT, PAGES, CONTENTS, PAGE, TABLE, IMAGES, IMAGE = (
    "> **문서 정보**", "> - 작성자: ", "> - 포맷: ", "> - 페이지: ", "## 목차", "## 페이지 ", "### 테이블 ", "## 이미지", "이미지 ",
)


def document(**fields: Column) -> Column:
    """The struct, with empty strings, arrays and one page where a field is not given."""

    def empty(kind: str) -> Column:
        return F.array().cast(kind) if kind.startswith("array") else F.lit(1 if kind == "int" else "").cast(kind)

    return F.struct(*[F.coalesce(fields[n].cast(kind), empty(kind)).alias(n) if n in fields else empty(kind).alias(n) for n, kind in FIELDS.items()])


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _when(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast("array<string>"))


def _tables(tables: Column) -> Column:
    number = lambda i: F.concat(F.lit(TABLE), (i + 1).cast("string"))
    return F.flatten(F.transform(tables, lambda t, i: _lines(number(i), "", t["markdown"], "")))


def to_markdown(doc: Column, include_images: bool = False) -> Column:
    """Title, facts, contents, then pages with their tables, or the text and its tables, then images.

    A title counts only with a file name, whose stem stands in for it.
    """
    d = lambda name: doc[name]
    stem = F.regexp_replace(F.regexp_extract(d("filename"), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    title = F.when(d("filename") == "", "Document").when(d("title") != "", d("title")).otherwise(stem)
    several = d("page_count") > 1
    facts = F.concat(
        _lines(INFO), _when(d("author") != "", _lines(F.concat(F.lit(AUTHOR), d("author")))),
        _when(d("format") != "", _lines(F.concat(F.lit(FORMAT), F.upper(d("format"))))),
        _when(several, _lines(F.concat(F.lit(PAGES), d("page_count").cast("string")))), _lines(""),
    )
    entries = F.transform(d("headings"), lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- "), h["text"]))
    page = lambda p: F.concat(
        _when(several, _lines(F.concat(F.lit(PAGE), p["page"].cast("string")), "")),
        _when(p["text"] != "", _lines(p["text"], "")), _tables(p["tables"]),
    )
    flat = _when(d("text") != "", F.concat(_lines(d("text"), ""), _tables(d("tables"))))
    parts = [
        _lines(F.concat(F.lit("# "), title), ""), _when((d("author") != "") | several, facts),
        _when(F.size(d("headings")) > 0, F.concat(_lines(CONTENTS, ""), entries, _lines("", "---", ""))),
        F.when(F.size(d("pages")) > 0, F.flatten(F.transform(d("pages"), page))).otherwise(flat),
    ]
    if include_images:
        kind = lambda x: F.when(x["format"] == "", "image/png").otherwise(textops.media_type(F.concat(F.lit("."), x["format"])))
        shown = lambda x, i: F.concat(F.lit(f"![{IMAGE}"), (i + 1).cast("string"), F.lit("](data:"), kind(x), F.lit(";base64,"), F.base64(x["data"]), F.lit(")"))
        known = F.filter(F.transform(d("images"), lambda x, i: F.when(F.length(x["data"]) > 0, shown(x, i))), lambda x: x.isNotNull())
        parts.append(_when(F.size(d("images")) > 0, F.concat(_lines(IMAGES, ""), F.flatten(F.transform(known, lambda x: _lines(x, ""))))))
    return F.array_join(F.concat(*parts), "\n")


def to_json(doc: Column, include_images: bool = False, pretty: bool = False) -> Column:
    """The document's facts, content, pages, tables and images as JSON (R3); image data only where asked for."""
    names = ("page", "filename", "format")
    image = lambda x: F.struct(*[x[n].alias(n) for n in names], *([F.base64(x["data"]).alias("base64")] if include_images else []))
    shape = F.struct(
        F.struct(*[doc[n].alias(n) for n in ("filename", "format", "page_count", "title", "author")]).alias("metadata"),
        F.struct(doc["text"].alias("text"), doc["headings"].alias("headings")).alias("content"),
        doc["pages"].alias("pages"), doc["tables"].alias("tables"), F.transform(doc["images"], image).alias("images"),
    )
    return F.to_json(shape, {"pretty": str(pretty).lower()})


def slide_text(title: Column, texts: Column) -> Column:
    """A slide's marked title, then its boxes that are neither blank nor the title."""
    own = F.filter(texts, lambda t: t.rlike(r"\S") & (t != title))
    return F.array_join(F.concat(_when(title != "", _lines(F.concat(F.lit("# "), title))), own), "\n\n")


def paged_text(pages: Column, mark: str = "--- Page {} ---", skip: bool = True) -> Column:
    """Pages (structs of page and text) under their numbers; empty ones skipped where asked."""
    before, after = mark.split("{}")
    pages = F.filter(pages, lambda p: p["text"] != "") if skip else pages
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit(before), p["page"].cast("string"), F.lit(f"{after}\n\n"), p["text"])), "\n\n")


def workbook_text(sheets: Column) -> Column:
    """Sheets (structs of name and grid) as tab-separated text, each under its name."""
    one = lambda s: _lines(F.concat(F.lit("=== "), s["name"], F.lit(" ===")), render.tsv(s["grid"]), "")
    return F.array_join(F.flatten(F.transform(sheets, one)), "\n")


def is_data_table(grid: Column) -> Column:
    """Two rows and two columns at least, and three tenths of the cells not blank; else the table is layout."""
    cells = F.flatten(grid)
    full = F.size(F.filter(cells, lambda c: c.rlike(r"\S")))
    wide = F.array_max(F.transform(grid, F.size)) >= 2
    return F.coalesce((F.size(grid) >= 2) & wide & (10 * full >= 3 * F.size(cells)), F.lit(False))


def row_texts(grid: Column) -> Column:
    """The rows of a layout table as lines of text, blank ones dropped."""
    trimmed = F.transform(grid, lambda r: F.transform(r, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.filter(F.transform(trimmed, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), lambda t: t != "")


def pdf_image_format(name: Column) -> Column:
    """The format of an image by its filter."""
    kinds = F.create_map(*[F.lit(x) for kv in {"DCTDecode": "jpeg", "JPXDecode": "jp2", "CCITTFaxDecode": "tiff", "FlateDecode": "raw"}.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, name), F.lit("unknown"))
