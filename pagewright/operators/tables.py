"""Tables of a PDF page: by rulings, by horizontal rules, by aligned text, and by projection of the text.

Works on one page's items (top down) and rulings (in the page's own coordinates, y upwards), as ``pages`` does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from statistics import mean

from pagewright.operators.pages import Item, Ruled, anchored, binned, chained

#: Fixed values, in points unless said otherwise.
ROW_MERGE, CELL, BORDER_SHARE, PAGE_NUMBER = 15, 3, 0.4, r"-\s*\d+\s*-"
#: Fixed values of the split-sentence test (T14): what ends a sentence, Korean endings, and beginnings that go on.
ENDS = (".", "!", "?", "。", ")", "」", ", ")
KOREAN_ENDS = ("다.", "함.", "임.", "음.", "됨.", "있다.", "한다.", "된다.", "없다.", "않다.", "이다.", "하다.")
KOREAN_GOES_ON = (
    "도 ", "를 ", "을 ", "에 ", "의 ", "와 ", "과 ", "으로", "에서", "하여", "하고", "하는", "되는", "된 ", "한 ", "할 ", "다고",
    "부 ", "등 ", "이상", "이하", "위한", "관한",
)
#: Fixed values of the prose test (T13): bullets, and what a line of prose ends with.
BULLET, PROSE_ENDS = re.compile("[◦○●◆■□➀➁➂➃\\-·•※▶►▷△▲]"), ".。,，"


@dataclass
class Table:
    """Cells by (row, column), and the table's place on the page (its top left corner)."""

    cells: dict[tuple[int, int], str]
    rows: int
    cols: int
    x: float
    y: float
    width: float
    height: float
    method: str

    def grid(self) -> list[list[str]]:
        """All cells, white space runs as one blank."""
        return [[" ".join(self.cells.get((r, c), "").split()) for c in range(self.cols)] for r in range(self.rows)]

    def full(self) -> int:
        return sum(bool(t.strip()) for t in self.cells.values())


def cell_text(items: list[Item]) -> str:
    """A cell's lines, each left to right."""
    lines = anchored(sorted(items, key=lambda i: (i.y, i.x)), lambda i: i.y, 5)
    return "\n".join(" ".join(i.text for i in sorted(line, key=lambda i: i.x)) for line in lines).strip()


def clustered(values: list[float], tolerance: float = 4) -> list[float]:
    """Means of values that lie within ``tolerance`` of the one before; lone ones are dropped."""
    return [mean(g) for g in chained(sorted(values), float, tolerance) if len(g) >= 2]


def clustered_bounded(values: list[float], tolerance: float = 4, span: float = 8) -> list[float]:
    """The same, no cluster wider than ``span``; lone values stay."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= tolerance and v - groups[-1][0] <= span:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [mean(g) for g in groups]


def _filled(table: Table, share: float) -> bool:
    return bool(table.cells) and table.full() >= share * len(table.cells)


def _cells(items: list[Item], xs: list[float], ys: list[float], left: float, top: float, bottom: float, exclusive: bool = False) -> dict[tuple[int, int], str]:
    """The text between boundaries, with tolerances; an item near a boundary is in both cells, or in its own if ``exclusive``."""
    held = {(r, c): [] for r in range(len(ys) - 1) for c in range(len(xs) - 1) if xs[c + 1] - xs[c] >= 5}
    for i in items:
        near = [(r, c) for r, c in held if xs[c] - left <= i.x <= xs[c + 1] + left and ys[r] - top <= i.y <= ys[r + 1] + bottom]
        if exclusive and near:
            off = lambda v, a, z: max(a - v, 0, v - z) if v != z else 1e-9
            near = [min(near, key=lambda p, i=i: off(i.x, xs[p[1]], xs[p[1] + 1]) + off(i.y, ys[p[0]], ys[p[0] + 1]))]
        for p in near:
            held[p].append(i)
    return {p: cell_text(own) for p, own in held.items()}


def regions(ruled: Ruled) -> list[Ruled]:
    """Vertical rulings whose extents overlap, with the horizontal ones beside them; three of each at least."""
    spans: list[list] = []
    for d in sorted(ruled.down, key=lambda d: d[1]):
        if spans and d[1] < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], d[2])
            spans[-1][2].append(d)
        else:
            spans.append([d[1], d[2], [d]])
    found = [Ruled([a for a in ruled.across if low - 5 <= a[0] <= high + 5], own) for low, high, own in spans]
    return [r for r in found if len(r.across) >= 3 and len(r.down) >= 3]


def _below(items: list[Item], last: float, left: float, right: float) -> list[float]:
    """Boundaries of rows that go on below the last rule."""
    own = [i for i in items if last + 3 < i.y < last + 50 and left - 5 <= i.x <= right + 5 and not re.fullmatch(PAGE_NUMBER, i.text.strip())]
    rows, before = [], last
    for y, group in binned(own, lambda i: i.y, 5).items():
        if y - before > 30 or re.fullmatch(PAGE_NUMBER, " ".join(i.text.strip() for i in group).strip()):
            break
        rows.append(y)
        before = y
    return [*rows, before + 15] if len(rows) >= 2 else rows


def grid_table(ruled: Ruled, items: list[Item], height: float, exclusive: bool = False) -> Table | None:
    """The table of a region of rulings."""
    xs, levels = sorted(clustered([d[0] for d in ruled.down])), clustered_bounded([a[0] for a in ruled.across])
    if len(xs) < 3 or len(levels) < 3:
        return None
    ys = sorted(height - y for y in levels)
    rows = [ys[0]]
    for y in [*ys[1:], *_below(items, ys[-1], xs[0], xs[-1])]:
        if y - rows[-1] > ROW_MERGE:
            rows.append(y)
    top = min(height - d[2] for d in ruled.down)
    headless = top < rows[0] - 5 and any(top - 5 < i.y < rows[0] and xs[0] - 5 <= i.x <= xs[-1] + 5 for i in items)
    if headless:
        rows.insert(0, top - 2)
    if len(rows) < 3:
        return None
    cells = _cells(items, xs, rows, CELL, CELL, CELL, exclusive)
    first = [i for i in items if rows[0] - 5 <= i.y <= rows[1] + 3 and xs[0] - 3 <= i.x <= xs[-1] + 3]
    if any(t.strip() for (r, _), t in cells.items() if r == 0) and any(i.y < rows[0] for i in first) and all(i.y < rows[0] for i in first):
        cells, rows = {(r - 1, c): t for (r, c), t in cells.items() if r}, rows[1:]  # what stands above is a caption
    words = lambda n: {w for (r, _), t in cells.items() if r == n for w in t.split()}
    many = len(rows) - 1
    last, before = words(many - 1), words(many - 2)
    if many >= 2 and last and before and len(last & before) >= 0.8 * len(last):
        cells, many = {k: t for k, t in cells.items() if k[0] < many - 1}, many - 1  # the row before, seen twice
    table = Table(cells, many, len(xs) - 1, xs[0], rows[0], xs[-1] - xs[0], rows[many] - rows[0], "grid")
    return table if many >= 2 and table.cols >= 2 and _filled(table, 0.1) else None


def by_grid(items: list[Item], ruled: Ruled, width: float, height: float, exclusive: bool = False) -> list[Table]:
    """Tables of crossing rulings, the page's border aside; where none cross, those of horizontal rules."""
    if len(ruled.across) < 3:
        return []
    across = [a for a in ruled.across if not (a[1] < 1 and a[2] > width - 2)]
    down = [d for d in ruled.down if d[2] - d[1] < BORDER_SHARE * height and 2 < d[0] < width - 2]
    if len(ruled.down) < 3 or not down or not across:
        return by_rules(items, across if len(ruled.down) >= 3 else ruled.across, height, exclusive)
    found = (grid_table(r, items, height, exclusive) for r in regions(Ruled(across, down)))
    return [t for t in found if t]


def by_rules(items: list[Item], across: list, height: float, exclusive: bool = False) -> list[Table]:
    """Tables between horizontal rules of like extent (D13, D14), those with most cells first where they overlap."""
    lines = sorted(((a[1], a[2], height - a[0]) for a in across if a[2] - a[1] >= 30))
    groups: list[list] = []
    for line in lines if len(lines) >= 3 else []:
        if groups and all(abs(line[k] - groups[-1][0][k]) < 30 for k in (0, 1)):
            groups[-1].append(line)
        else:
            groups.append([line])
    found = [t for g in groups if len(g) >= 3 and (t := rule_table(g, items, exclusive))]
    kept: list[Table] = []
    for t in sorted(found, key=lambda t: -len(t.cells)):
        if all(_shared(t.y, t.height, k.y, k.height) <= 0.5 * min(t.height, k.height) for k in kept):
            kept.append(t)
    return kept


def _shared(a: float, la: float, b: float, lb: float) -> float:
    return max(0.0, min(a + la, b + lb) - max(a, b))


def column_boundaries(items: list[Item], right: float) -> list[float]:
    """Left edges of columns where text starts twice or more, and the right edge."""
    often = [x for x, g in binned(items, lambda i: i.x, 5).items() if len(g) >= 2]
    groups = chained(often, float, 30)
    return sorted([*[g[0] - 5 for g in groups], right + 5]) if len(groups) >= 2 else []


def rule_table(lines: list[tuple], items: list[Item], exclusive: bool = False) -> Table | None:
    """The longest run of rows between rules whose text spreads over columns."""
    ys, left, right = sorted({round(line[2], 1) for line in lines}), min(line[0] for line in lines), max(line[1] for line in lines)

    def inside(r: int) -> list[Item]:
        return [i for i in items if left - 5 <= i.x <= right + 5 and ys[r] - 2 <= i.y <= ys[r + 1] - 2]

    def valid(r: int) -> bool:
        own = inside(r)
        places = {round(i.x / 10) * 10 for i in own}
        return ys[r + 1] - ys[r] <= 60 and len(places) >= 2 and all(len(i.text.strip()) <= 50 for i in own) and max(places) - min(places) >= 0.3 * (right - left)

    good = [r for r in range(len(ys) - 1) if valid(r)]
    run = max(chained(good, float, 1), key=len, default=[])
    if len(ys) < 3 or len(run) < 2:
        return None
    rows = {ys[run[-1] + 1]}
    for r in run:
        rows |= {ys[r], *(y for i in inside(r) if (y := round(i.y / 5) * 5) > ys[r] + 2)}
    rows, xs = sorted(rows), column_boundaries([i for r in good for i in inside(r)], right)
    if len(rows) < 3 or len(xs) < 2:
        return None
    cells = _cells(items, xs, rows, 5, 2, -2, exclusive)
    table = Table(cells, len(rows) - 1, len(xs) - 1, left, rows[0], right - left, rows[-1] - rows[0], "hline")
    return table if _filled(table, 0.2) else None


def by_alignment(items: list[Item], width: float, exclusive: bool = False) -> list[Table]:
    """Tables of aligned text, in each half of a page with a wide gap in its middle, else in the whole."""
    if len(items) < 8:
        return []
    places = sorted({round(i.x / 10) * 10 for i in items})
    gaps = [(b - a, -a, (a + b) / 2) for a, b in zip(places, places[1:]) if b - a >= 30 and 0.25 * width <= (a + b) / 2 <= 0.75 * width]
    if width > 0 and gaps:
        middle = max(gaps)[2]
        sides = [[i for i in items if (i.x < middle) == left] for left in (True, False)]
        if min(map(len, sides)) >= 10:
            found = [t for side in sides for t in aligned_tables(side, exclusive)]
            if found:
                return found
    return aligned_tables(items, exclusive)


def aligned_tables(items: list[Item], exclusive: bool = False) -> list[Table]:
    """Runs of four or more rows with text in several columns, two others between them at most."""
    lines = binned(items, lambda i: i.y, 5)
    keys = list(lines)
    data = [k for k, y in enumerate(keys) if len(chained(sorted(i.x for i in lines[y]), float, 30)) >= 2 and max(len(i.text.strip()) for i in lines[y]) <= 50]
    runs = [[keys[k] for k in run] for run in chained(data, float, 3) if len(run) >= 4]
    return [t for run in runs if (t := aligned_table(run, lines, exclusive))]


def aligned_table(run: list[float], lines: dict[float, list[Item]], exclusive: bool = False) -> Table | None:
    """The table of a run of data rows and what stands between them."""
    held = [i for y in run for i in lines[y]]
    often = [x for x, g in binned(held, lambda i: i.x, 10).items() if len(g) >= 3]
    groups = chained(often, float, 30)
    if len(groups) < 2:
        return None
    xs = [*[g[0] - 5 for g in groups], max(i.x for i in held) + 50]
    ys = [y for y in lines if run[0] <= y <= run[-1]]
    cells = {}
    for r, y in enumerate(ys):
        for c, (a, b) in enumerate(zip(xs, xs[1:])):
            cells[r, c] = " ".join(i.text for i in sorted(lines[y], key=lambda i: i.x) if (a <= i.x < b if exclusive else a - 5 <= i.x <= b + 5)).strip()
    table = Table(cells, len(ys), len(xs) - 1, xs[0], run[0], xs[-1] - xs[0], run[-1] - run[0], "alignment")
    return table if table.rows >= 3 and _filled(table, 0.2) and not _reads_as_prose(table) else None


def _number(text: str) -> bool:
    return re.sub(r"[ ,.%\-]", "", text).isdigit()


def _fragment(text: str) -> bool:
    """Does a cell look like a piece of a sentence?"""
    last = text.split()[-1] if text.split() else ""
    return (len(text) > 20 and last.islower() and len(last) > 3) or (text[0].islower() and len(text) > 10) or text.endswith((",", ":")) or (text[0] in ")]}" and len(text) > 3)


def _reads_as_prose(table: Table) -> bool:
    texts = [t.strip() for t in table.cells.values() if t.strip()]
    if table.cols <= 2 and sum(len(t) <= 15 or _number(t) for t in texts) < 0.3 * len(texts):
        return True
    if sum(len(t) > 30 for t in texts) > 0.5 * len(texts):
        return True
    if len(re.findall(r"(?<![a-zA-Z])[a-z](?![a-zA-Z])", " ".join(texts))) > len(texts):
        return True  # variables of formulas
    heads: list[str] = []
    for row in table.grid()[:3]:
        if len(heads) < 3:
            heads += [t for t in row if t and not re.match(r"Table\s+\d", t)]
    return bool(heads) and (heads[0][0].islower() or bool(re.match(r"\d+\.\d+", heads[0])) or 2 * sum(map(_fragment, heads)) >= len(heads))


def by_projection(items: list[Item], least_rows: int = 2, least_cols: int = 2) -> list[Table]:
    """Tables of text that falls into columns (D1): blocks, candidates, stitched and tested, from the top down."""
    blocks = chained(sorted(items, key=lambda i: i.y), lambda i: i.y, 25)  # D3
    found = [t for b in blocks if (t := block_table(b, least_cols))]
    return [t for t in stitched(found) if is_table(t, least_rows, least_cols)]


def _prose(rows: list[list[Item]]) -> bool:
    """Do up to four rows read as a list of bullets or as sentences?"""
    lines = [[i for i in sorted(row, key=lambda i: i.x) if i.text.strip()] for row in rows]
    texts = [" ".join(i.text for i in line).strip() for line in lines]
    if texts and BULLET.match(texts[0]) and all(not t or BULLET.match(t) or re.match("[A-Z가-힣]", t) for t in texts[1:]):
        return True
    starts = [line[0].x for line in lines if line]
    even = bool(starts) and max(starts) - min(starts) < 15
    return even and all(len(t) < 3 or t.startswith(("-", "·")) or t[-1] in PROSE_ENDS for t in texts)


def block_table(items: list[Item], least_cols: int) -> Table | None:
    """The candidate of a block: rows of five points, columns by merged extents, items by the nearest column."""
    rows: dict[int, list[Item]] = {}
    for i in items:
        rows.setdefault(int(i.y / 5), []).append(i)
    lines = [rows[k] for k in sorted(rows)]
    if len(items) < 3 or len(lines) < 2 or (len(lines) <= 4 and _prose(lines)):
        return None
    columns: list[list[float]] = []
    for a, b in sorted((i.x, i.x + max(10, len(i.text) * i.size * 0.6)) for i in items):
        if columns and a < columns[-1][1] + 20:
            columns[-1][1] = max(columns[-1][1], b)
        else:
            columns.append([a, b])
    if len(columns) < least_cols:
        return None
    texts: dict[tuple[int, int], list[str]] = {}
    for r, line in enumerate(lines):
        for i in sorted(line, key=lambda i: i.x):
            near = [(abs(i.x - a), c) for c, (a, b) in enumerate(columns) if a - 25 <= i.x <= b + 25]
            if near:
                texts.setdefault((r, min(near)[1]), []).append(i.text)
    left, top = min(i.x for i in items), min(i.y for i in items)
    right, bottom = max(i.x + len(i.text) * i.size for i in items), max(i.y for i in items)
    return Table({k: " ".join(t) for k, t in texts.items()}, len(lines), len(columns), left, top, right - left, bottom - top, "visual-projection")


def stitched(tables: list[Table]) -> list[Table]:
    """Tables under each other become one where they overlap in width."""
    out: list[Table] = []
    for t in sorted(tables, key=lambda t: t.y):
        a = out[-1] if out else None
        gap = t.y - a.y - a.height if a else 0
        if a and _shared(a.x, a.width, t.x, t.width) > 0.7 * (min(a.width, t.width) or 1) and -30 < gap < (70 if a.cols == t.cols else 50):
            right, bottom = max(a.x + a.width, t.x + t.width), max(a.y + a.height, t.y + t.height)
            cells = a.cells | {(r + a.rows, c): x for (r, c), x in t.cells.items()}
            x, y = min(a.x, t.x), min(a.y, t.y)
            out[-1] = replace(a, cells=cells, rows=a.rows + t.rows, cols=max(a.cols, t.cols), x=x, y=y, width=right - x, height=bottom - y)
        else:
            out.append(t)
    return out


def split_sentence(cells: list[str]) -> bool:
    """Are a row's cells one sentence cut in pieces?"""
    if len(cells) < 2 or not cells[0] or not cells[-1]:
        return False
    first, last = cells[0], cells[-1]
    end, begin = first.rstrip(), last.rstrip()
    cut = len(first) > 15 and not end.endswith(ENDS) and len(last) < len(first) and not last[0].isupper() and not last[0].isdigit()
    bracket = end.endswith(("「", "(", "[")) and not begin.startswith(("「", "(", "["))
    tail = len(cells) == 2 and len(last.split()) <= 3 <= len(first.split()) and not end.endswith(KOREAN_ENDS)
    middle = cells[1:-1]
    thin = bool(middle) and 2 * sum(len(c.split()) <= 2 for c in middle) >= len(middle) and len(" ".join(cells)) > 20
    return cut or last.startswith(KOREAN_GOES_ON) or bracket or last.startswith(("」", ")", "]")) or tail or thin


def is_table(table: Table, least_rows: int = 2, least_cols: int = 2) -> bool:
    """Size, filling and length of cells, and no sentences in columns."""
    full, total, grid = table.full(), table.rows * table.cols, table.grid()
    if table.rows < least_rows or table.cols < max(least_cols, 2) or (total > 6 and full < 0.1 * total):
        return False
    if max((len(t) for t in table.cells.values()), default=0) > 500 or (table.rows > 3 and 1 - full / total > 0.7):
        return False
    rows = [own for row in grid if (own := [c for c in row if c])]
    if table.rows <= 4 and rows and sum(len(r) < 2 or split_sentence(r) for r in rows) >= 0.6 * len(rows):
        return False
    short = lambda t: len(t) <= 5 or t.replace(" ", "").replace(",", "").replace(".", "").isdigit()
    return not (table.rows <= 3 and table.cols == 2 and not any(short(c) for row in grid for c in row if c))


def page_tables(items: list[Item], ruled: Ruled, width: float, height: float, exclusive: bool = False) -> list[Table]:
    """A page's tables (D6): by grid; else by rules and alignment, those with more cells where they overlap; else by projection."""
    found = by_grid(items, ruled, width, height, exclusive)
    if found:
        return found
    rest = by_rules(items, ruled.across, height, exclusive) + by_alignment(items, width, exclusive)
    kept: list[Table] = []
    for t in sorted(rest, key=lambda t: -len(t.cells)):
        over: Callable[[Table], bool] = lambda k, t=t: (
            _shared(t.y, t.height, k.y, k.height) > 0.3 * min(t.height, k.height) and _shared(t.x, t.width, k.x, k.width) > 0.3 * min(t.width, k.width)
        )
        if not any(over(k) for k in kept):
            kept.append(t)
    return kept or by_projection(items)


def words(items: list[Item]) -> list[Item]:
    """Items of a line that stand close together, as one."""
    out: list[Item] = []
    for line in anchored(sorted(items, key=lambda i: (i.y, i.x)), lambda i: i.y, 5):
        for i in sorted(line, key=lambda i: i.x):
            a = out[-1] if out else None
            if a and abs(a.y - i.y) <= 5 and 0 <= i.x - a.x and i.x - (a.x + len(a.text) * a.size * 0.5) <= 0.8 * i.size:
                out[-1] = a._replace(text=a.text + i.text)
            else:
                out.append(i)
    return out


def by_rectangles(rects: list[tuple[float, float, float, float]], items: list[Item], height: float) -> Table | None:
    """The table whose cells are drawn as rectangles of over ten points a side (S9); corners upwards, items top down."""
    if len(rects) < 4:
        return None
    edges = lambda values: [mean(g) for g in chained(sorted(values), float, 10)]
    xs, ys = edges([r[0] for r in rects]), edges([height - r[3] for r in rects])
    cells: dict[tuple[int, int], str] = {}
    for x0, y0, x1, y1 in rects:
        place = min(range(len(ys)), key=lambda k: abs(ys[k] - (height - y1))), min(range(len(xs)), key=lambda k: abs(xs[k] - x0))
        cells[place] = cell_text([i for i in words(items) if x0 - 3 <= i.x <= x1 + 3 and height - y1 - 3 <= i.y <= height - y0 + 3])
    table = Table(cells, len(ys), len(xs), xs[0], ys[0], max(r[2] for r in rects) - xs[0], height - min(r[1] for r in rects) - ys[0], "rectangles")
    return table if table.full() >= 3 and table.rows >= 2 and table.cols >= 2 else None
