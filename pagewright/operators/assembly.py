"""Files of every format to one document struct each (E1): decoded once, in the task that read them, without a shuffle."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import document, encodings
from pagewright.operators import images, pages, tables, tagged
from pagewright.sources import compound, ooxml, pdf
from pagewright.sources.decoding import decoded

_FIELDS = ", ".join(f"{n}: {kind}" for n, kind in document.FIELDS.items())
SCHEMA = f"doc_id bigint, doc struct<{_FIELDS}>, error string"
Grid = list[list[str]]


def markdown(grid: Grid, width: int | None = None, caption: str = "") -> str:
    """A pipe table with the first row as its header, rows padded and cut to a width: by default the longest row's."""
    width = max(map(len, grid), default=0) if width is None else width
    lines = [f"| {' | '.join((r + [''] * width)[:width])} |" for r in grid]
    rule = [f"| {' | '.join(['---'] * width)} |"]
    return "\n".join([*([f"**{caption}**", ""] if caption else []), *lines[:1], *rule, *lines[1:]]) if grid else ""


def _table(grid: Grid, page: int = 1, name: str = "", width: int | None = None) -> dict:
    return {"page": page, "name": name, "rows": len(grid), "cols": max(map(len, grid), default=0), "markdown": markdown(grid, width)}


def _page(number: int, text: str, name: str = "", own: list[dict] = ()) -> dict:
    return {"page": number, "name": name, "text": text, "tables": list(own)}


def document_of(**given) -> dict:
    """The fields of a document; what is not given is empty."""
    empty = {n: [] if kind.startswith("array") else 1 if kind == "int" else "" for n, kind in document.FIELDS.items()}
    return empty | given


def _grids(rows: Iterable[tuple], first: int = 0, level: int | None = None) -> dict[int, Grid]:
    """Cells by part as dense grids from ``first`` on; cells of one place join by a blank."""
    cells: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        if r[0] == "cell" and (level is None or r[6] == level):
            cells[r[1]][r[2], r[3]].append(r[4])
    found = {}
    for part, own in cells.items():
        high, wide = max(r for r, _ in own), max(c for _, c in own)
        grid = [[""] * (wide - first + 1) for _ in range(high - first + 1)]
        for (r, c), texts in own.items():
            grid[r - first][c - first] = " ".join(texts)
        found[part] = grid
    return found


def _named(rows: Iterable[tuple]) -> dict[str, str]:
    return {r[5]: r[4] for r in rows if r[0] == "property"}


def _pictures(rows: Iterable[tuple], page: int = 1) -> list[dict]:
    kind = lambda r: r[5] or r[4].rsplit(".", 1)[-1].lower()
    return [{"page": page, "filename": r[4].rsplit("/", 1)[-1], "format": kind(r), "data": r[7]} for r in rows if r[0] == "image"]


def written(rows: list[tuple], format: str) -> dict:
    """docx, hwpx, hwp and doc: paragraphs with marked headings as one text, tables, images."""
    shown = [r for r in rows if r[0] == "paragraph" and r[4].strip() and not (format == "hwpx" and r[3])]
    grids, names = _grids(rows), _named(rows)
    if format == "hwpx":
        grids = {k: g for k, g in grids.items() if is_data(g)}
    return document_of(
        format=format, title=names.get("title", ""), author=names.get("creator", ""),
        text="\n\n".join(f"{'#' * r[6]} {r[4]}" if r[6] else r[4] for r in shown), headings=[{"level": r[6], "text": r[4]} for r in shown if r[6]],
        tables=[_table(g, width=len(g[0]) if format == "docx" else None) for _, g in sorted(grids.items())], images=_pictures(rows),
    )


def is_data(grid: Grid) -> bool:
    """Two rows and columns at least, and three tenths of the cells not blank."""
    cells = [c for r in grid for c in r]
    return len(grid) >= 2 and max(map(len, grid)) >= 2 and 10 * sum(bool(c.strip()) for c in cells) >= 3 * len(cells)


def presentation(rows: list[tuple]) -> dict:
    """pptx: a page a slide; a slide without a title takes up to 50 characters of its first line."""
    shapes, names = defaultdict(list), _named(rows)
    for r in rows:
        if r[0] == "shape":
            shapes[r[1]].append(r)
    made, headings, every = [], [], []
    for part in (r[1] for r in rows if r[0] == "slide"):
        own = shapes[part]
        title = next((r[4] for r in own if r[5] == "title"), own[0][4].split("\n")[0][:50] if own else "")
        text = "\n\n".join([*([f"# {title}"] if title else []), *(r[4] for r in own if r[4].strip() and r[4] != title)])
        grids = [_table(g, part + 1) for _, g in sorted(_grids(rows, level=part).items())]
        made.append(_page(part + 1, text, title, grids))
        every += grids
        headings += [{"level": 1, "text": title}] if title else []
    return document_of(
        format="pptx", page_count=len(made), title=names.get("title", ""), author=names.get("creator", ""), headings=headings,
        text="\n\n".join(p["text"] for p in made), pages=[p | {"name": ""} for p in made], tables=every, images=_pictures(rows),
    )


def binary_presentation(rows: list[tuple]) -> dict:
    """ppt: texts dealt to slides."""
    names, made = _named(rows), []
    for i, (title, texts) in enumerate(compound.slides([r[4] for r in rows if r[0] == "shape"]), 1):
        made.append((_page(i, "\n".join([*([title] if title else []), *texts])), title))
    return document_of(
        format="ppt", page_count=len(made), title=names.get("title", ""), author=names.get("creator", ""), pages=[p for p, _ in made],
        text="\n\n".join(f"=== 슬라이드 {p['page']} ===\n{p['text']}" for p, _ in made), headings=[{"level": 1, "text": t} for _, t in made if t], images=_pictures(rows),
    )


def workbook(rows: list[tuple], format: str) -> dict:
    """xlsx and xls: a page and a table a sheet that has cells, in the workbook's order."""
    grids, names = _grids(rows, first=1), _named(rows)
    sheets = [(r[1], r[4]) for r in rows if r[0] == "sheet"]
    full = [(i, name, grids[i]) for i, name in sheets if i in grids]
    tsv = lambda g: "\n".join("\t".join(r) for r in g)
    made = [_table(g, i + 1, name) for i, name, g in full]
    return document_of(
        format=format, page_count=max(len(sheets), 1), title=names.get("title", ""), author=names.get("creator", ""),
        text="\n".join(x for _, name, g in full for x in (f"=== {name} ===", tsv(g), "")), headings=[{"level": 1, "text": n} for _, n in sheets],
        pages=[_page(i + 1, tsv(g), name, [t]) for (i, name, g), t in zip(full, made)], tables=made,
    )


def pdf_pages(rows: list[pdf.Row]) -> list[tuple[pdf.Row, list[pages.Item], pages.Ruled, list[pdf.Row]]]:
    """(page, items top down, rulings, the page's other rows) of a file's pages."""
    own = defaultdict(list)
    for r in rows:
        own[r.page].append(r)
    found = []
    for p in (r for r in rows if r.kind == "page"):
        items = pages.top_down([pages.Item(r.text, r.x, r.y, r.size, r.mcid) for r in own[p.page] if r.kind == "text"], p.y2)
        lines = [r for r in own[p.page] if r.kind == "ruling"]
        ruled = pages.Ruled([((r.y + r.y2) / 2, r.x, r.x2) for r in lines if r.text == "h"], [((r.x + r.x2) / 2, r.y, r.y2) for r in lines if r.text == "v"])
        found.append((p, items, ruled, own[p.page]))
    return found


def pdf_document(rows: list[pdf.Row]) -> dict:
    """pdf: pages with their text and tables, the outline of a tagged file, images."""
    names, roots, made, pictures = {r.font: r.text for r in rows if r.kind == "property"}, tagged.tree(rows), [], []
    by_tag = defaultdict(list)
    for page, grid, _ in tagged.tables(roots):
        by_tag[page].append(grid)
    for p, items, ruled, rest in pdf_pages(rows):
        grids = [t.grid() for t in tables.page_tables(items, ruled, p.x2, p.y2)]
        if roots and by_tag[p.page]:
            drawn = tables.by_rectangles([(r.x, r.y, r.x2, r.y2) for r in rest if r.kind == "rect"], items, p.y2)
            grids = [drawn.grid()] if drawn else by_tag[p.page]
        made.append(_page(p.page + 1, pages.page_text(items, ruled, p.x2, p.y2), "", [_table(g, p.page + 1) for g in grids]))
        for r in rest:
            if r.kind == "image":
                attrs = r.attrs or {}
                try:
                    ending, data = images.encoded(r.font, r.data or b"", int(r.x2), int(r.y2), attrs.get("color_space", ""), int(attrs.get("bits", 8)))
                except (ValueError, IndexError):
                    ending, data = ".bin", r.data
                pictures.append({"page": p.page + 1, "filename": r.text + ending, "format": {".jpg": "jpeg"}.get(ending, ending[1:]), "data": data})
    return document_of(
        format="pdf", page_count=len(made), title=names.get("title", ""), author=names.get("creator", ""), pages=made, images=pictures,
        text="\n\n".join(f"--- Page {p['page']} ---\n\n{p['text']}" for p in made if p["text"]), tables=[t for p in made for t in p["tables"]],
        headings=[{"level": level, "text": text} for level, text, _ in tagged.outline(roots)],
    )


def text_document(content: bytes, format: str) -> dict:
    """txt and md: the decoded text, and the headings of Markdown outside nothing, as T4 has them."""
    text, _ = encodings.decode(content)
    found = re.findall(r"^(#{1,6})\s+(.+)$", text, re.M) if format == "md" else []
    return document_of(format=format, text=text, headings=[{"level": len(m), "text": t} for m, t in found])


def document_from(content: bytes | None, format: str) -> tuple[dict, str | None]:
    """(document, what could not be read) of a file; a format that is not known reads as text."""
    content = bytes(content or b"")
    if format == "pdf":
        rows = list(pdf.decode(content))
        made, wrong = pdf_document(rows), [r.text for r in rows if r.kind == "error"]
        return made, "; ".join(wrong) or None
    if format in ooxml.DECODERS or format in compound.DECODERS:
        rows = list((ooxml if format in ooxml.DECODERS else compound).rows(content, format))
        wrong = "; ".join(r[4] for r in rows if r[0] == "error") or None
        if format in ("xlsx", "xls"):
            return workbook(rows, format), wrong
        return (presentation(rows) if format == "pptx" else binary_presentation(rows) if format == "ppt" else written(rows, format)), wrong
    return text_document(content, format or "txt"), None


def documents(files: DataFrame, filename: Column | None = None) -> DataFrame:
    """(doc_id, doc, error) of files with doc_id, content and format; a file that cannot be read has a null doc and the reason."""

    def rows(content: bytes, format: str, name: str):
        made, wrong = document_from(content, format)
        yield made | {"filename": name or ""}, wrong

    named = files.withColumn("filename", F.lit("") if filename is None else filename)
    return decoded(named, SCHEMA, rows, lambda reason: (None, reason), ("content", "format", "filename"))
