"""The structure tree of tagged PDF files: outline, tables and counts from the decoder's nodes and marks.

A mark's text is what was shown while its marked content was open, so text and node meet by number, not by place.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pagewright.sources.pdf import Row

#: The structure types with a name of their own.
TYPES = (
    "Document", "Part", "Sect", "Div", "Art", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody",
    "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Figure", "Caption", "Formula", "Form", "Link", "Note", "TOC", "TOCI",
)


@dataclass
class Node:
    kind: str
    page: int
    attrs: dict
    kids: list[Node] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)

    def text(self) -> str:
        """What stands for the node, its own text, or its children's."""
        own = self.attrs.get("ActualText") or " ".join(t for t in self.marks if t)
        return own.strip() or " ".join(t for k in self.kids if (t := k.text()))

    def walk(self) -> Iterable[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()


def kind_of(name: str) -> str:
    return name if name in TYPES else "Unknown"


def is_tagged(rows: Iterable[Row]) -> bool:
    """Does the file have a structure tree?"""
    return any(r.kind == "node" for r in rows)


def marked_texts(rows: Iterable[Row]) -> dict[tuple[int, int], str]:
    """The text of each marked content by page and number, its items in the order in which they were shown."""
    found: dict = defaultdict(list)
    for r in rows:
        if r.kind == "text" and r.mcid >= 0:
            found[r.page, r.mcid].append(r.text)
    return {k: " ".join(t.strip() for t in v if t.strip()) for k, v in found.items()}


def tree(rows: list[Row]) -> list[Node]:
    """The roots of the structure tree."""
    texts, nodes, roots = marked_texts(rows), {}, []
    for r in rows:
        if r.kind == "node":
            nodes[r.seq] = Node(r.text, r.page, r.attrs or {})
            (nodes[r.parent].kids if r.parent in nodes else roots).append(nodes[r.seq])
        elif r.kind == "mark" and r.parent in nodes:
            nodes[r.parent].marks.append(texts.get((r.page, r.mcid), ""))
            page = nodes[r.parent]
            page.page = r.page if page.page < 0 else page.page
    return roots


def outline(roots: list[Node]) -> list[tuple[int, str, int]]:
    """(level, text, page) of the headings in pre-order."""
    found = ((int(n.kind[1]), n.text(), n.page) for root in roots for n in root.walk() if re.fullmatch("H[1-6]", n.kind))
    return [h for h in found if h[1]]


def tables(roots: list[Node]) -> list[tuple[int, list[list[str]], bool]]:
    """(page, grid, whether its first row is a header) of the tables, rows padded to one width."""
    found = []
    for table in (n for root in roots for n in root.walk() if n.kind == "Table"):
        lines = [n for n in table.walk() if n.kind == "TR"]
        rows = [[c.text() for c in line.kids if c.kind in ("TH", "TD")] for line in lines]
        rows, width = [r for r in rows if r], max(map(len, rows), default=0)
        head = bool(lines) and any(c.kind == "TH" for c in lines[0].kids)
        if rows:
            found.append((table.page, [r + [""] * (width - len(r)) for r in rows], head))
    return found


def statistics(roots: list[Node]) -> dict[str, int]:
    """How many nodes there are of each type."""
    return dict(Counter(n.kind for root in roots for n in root.walk()))
