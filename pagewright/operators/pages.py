"""The text of a PDF page in reading order: lines and words, ruled columns, and two-column layout.

All work is on one page's items and rulings, which its decoder holds together, so nothing is shuffled.  Places are top
down (y grows downwards) unless said otherwise; rulings come in the page's own coordinates (y grows upwards).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from statistics import mean, median
from typing import NamedTuple

#: Tolerances in points and shares of the page.
LINE, SCALE_FROM, SCALE_TO = 5.0, 1500.0, 842.0
INNER = (0.12, 0.88)
COLUMN_ITEMS = 40


class Item(NamedTuple):
    text: str
    x: float
    y: float
    size: float
    mcid: int = -1


class Ruled(NamedTuple):
    """A page's rulings: horizontal ones as (y, from, to), vertical ones as (x, from, to)."""

    across: list[tuple[float, float, float]]
    down: list[tuple[float, float, float]]


def grows_up(ys: list[float]) -> bool:
    """Does y grow upwards?  The vote of the first 50 steps to another line."""
    steps = [b - a for a, b in zip(ys[:50], ys[1:51])]
    return len(ys) < 2 or sum(s < -5 for s in steps) > sum(s > 5 for s in steps)


def top_down(items: list[Item], height: float | None = None) -> list[Item]:
    """Items by line from the top, at the scale of a page.

    Places count from the topmost text; with the page's ``height`` from the page's top, where its rulings count from.
    """
    if not items:
        return []
    up, highest = grows_up([i.y for i in items]), max(i.y for i in items)
    if highest > SCALE_FROM:
        by = highest / SCALE_TO
        items, highest = [i._replace(x=i.x / by, y=i.y / by, size=i.size / by) for i in items], SCALE_TO
    if up:
        top = height if height is not None and height >= highest else highest
        items = [i._replace(y=top - i.y) for i in items]
    return sorted(items, key=lambda i: (i.y, i.x))


def anchored(values: Iterable, place: Callable, tolerance: float) -> list[list]:
    """Values in their order, a new group where one lies over ``tolerance`` from its group's first."""
    groups: list[list] = []
    for v in values:
        if groups and abs(place(v) - place(groups[-1][0])) <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return groups


def chained(values: Iterable, place: Callable, gap: float) -> list[list]:
    """Values in their order, a new group where one lies over ``gap`` from the one before."""
    groups: list[list] = []
    for v in values:
        if groups and place(v) - place(groups[-1][-1]) <= gap:
            groups[-1].append(v)
        else:
            groups.append([v])
    return groups


def binned(items: Iterable, place: Callable, step: float) -> dict[float, list]:
    found = defaultdict(list)
    for i in items:
        found[round(place(i) / step) * step].append(i)
    return dict(sorted(found.items()))


def _wide(c: str) -> bool:
    return c > "⹿"


def _width(text: str, size: float) -> float:
    return sum(size * (0.9 if _wide(c) else 0.45) for c in text)


def line_text(line: list[Item]) -> str:
    """The words of a line, left to right, by the gaps between its items."""
    line = sorted(line, key=lambda i: i.x)
    size = max((i.size for i in line if i.text), default=1.0)
    if size <= 2 and len(line) >= 3:  # sizes that small are not the font's: the pitch of wide characters stands in
        pitch = [b.x - a.x for a, b in zip(line, line[1:]) if a.text and b.text and _wide(a.text[-1]) and _wide(b.text[0]) and b.x > a.x]
        size = median(pitch) if pitch else size
    words: list[str] = []
    end = None
    for i in line:
        if not i.text:
            continue
        own = max(i.size, size) if i.size <= 2 else i.size
        if end is not None and i.x - end <= own * (1.2 if words[-1] and _wide(words[-1][-1]) else 0.9):
            words[-1] += i.text
        else:
            words.append(i.text)
        end = i.x + _width(i.text, own)
    out = ""
    for w in words:
        if w.strip():
            out += (" " if out and not out.endswith(" ") and not w.startswith(" ") else "") + w
    return out


def column_text(items: Iterable[Item]) -> str:
    """Items as lines of one column."""
    lines = anchored(sorted(items, key=lambda i: (i.y, i.x)), lambda i: i.y, LINE)
    return "\n".join(t for t in map(line_text, lines) if t.strip())


def column_separator(down: list, width: float) -> float | None:
    """The vertical ruling that parts the page's middle: three pieces at least, 200 points together."""
    best = None
    for x, n in Counter(round(d[0]) for d in down).items():
        if n >= 3 and abs(x - width / 2) < 0.3 * width:
            span = sum(d[2] - d[1] for d in down if abs(round(d[0]) - x) < 2)
            if span >= 200 and (best is None or span > best[0]):
                best = span, x
    return best[1] if best else None


def inner_boundaries(ruled: Ruled, items: list[Item], width: float, height: float) -> list[float]:
    """Vertical rulings inside the page that are a fifth of the table high and that few lines run across."""
    levels = sorted({round(a[0]) for a in ruled.across})
    tall = levels[-1] - levels[0] if len(levels) >= 2 else height
    total: Counter = Counter()
    for x, a, b in ruled.down:
        total[round(x)] += b - a
    found = sorted(float(x) for x, h in total.items() if h >= 0.2 * tall and INNER[0] * width < x < INNER[1] * width)
    if len(found) < 3:
        return found
    inside = [i for i in items if height - levels[-1] - 5 <= i.y <= height - levels[0] + 5]
    lines = [g for g in binned(inside, lambda i: i.y, 3).values() if len(g) >= 2]

    def crossed(x: float) -> bool:
        over = sum(any(i.x < x - 2 for i in g) and any(i.x > x + 2 for i in g) for g in lines)
        return bool(lines) and over > 0.6 * len(lines)

    return [x for k, x in enumerate(found) if k in (0, len(found) - 1) or not crossed(x)]


def _rows_by_rulings(down: list, width: float, height: float, top: float, bottom: float) -> list[float]:
    """Ends of the inner vertical rulings (P20)."""
    ends = {round(height - y) for x, a, b in down if INNER[0] * width < round(x) < INNER[1] * width for y in (a, b)}
    return sorted(y for y in ends if top - 5 <= y <= bottom + 5)


def _rows_by_gaps(items: list[Item]) -> list[float]:
    """Boundaries in the gaps of over one and a half font sizes."""
    size = mean((i.size or 10) for i in items)
    ys = sorted({round(i.y, 1) for i in items})
    if len(ys) < 2:
        return [min(i.y for i in items) - 1, max(i.y for i in items) + size + 1]
    return [ys[0] - 1, *[(a + b) / 2 for a, b in zip(ys, ys[1:]) if b - a > 1.5 * size], ys[-1] + size + 1]


def _by_column(items: list[Item], bounds: list[float]) -> list[list[Item]]:
    columns: list[list[Item]] = [[] for _ in range(len(bounds) + 1)]
    for i in items:
        columns[sum(i.x >= b for b in bounds)].append(i)
    return columns


def _row_text(items: list[Item], bounds: list[float]) -> str:
    """A row's cells, each on a line; a cell of one or two items joins a fuller one to its left."""
    columns = _by_column(items, bounds)
    for c in range(len(columns) - 1, 0, -1):
        if len(columns[c]) <= 2 < len(columns[c - 1]):
            columns[c - 1] += columns[c]
            columns[c] = []
    cells = (" ".join(column_text(c).strip().split("\n")) for c in columns if c)
    return "\n".join(c for c in cells if c)


def ruled_text(items: list[Item], bounds: list[float], ruled: Ruled, width: float, height: float, extent: tuple[float, float] | None) -> str:
    """Text above, in and below ruled columns (P19): up to two boundaries column by column, else row by row."""
    bounds, levels = sorted(bounds), sorted({round(a[0]) for a in ruled.across})
    if extent is None and len(levels) < 3:
        return column_text(items)
    top, bottom = extent or (height - levels[-1], height - levels[0])
    parts: list[list[Item]] = [[], [], []]
    for i in items:
        parts[0 if i.y < top - 5 else 2 if i.y > bottom + 5 else 1].append(i)
    above, inside, below = parts
    if not inside:
        middle = ""
    elif len(bounds) <= 2:
        middle = "\n".join(t for t in (column_text(c).strip() for c in _by_column(inside, bounds)) if t)
    else:
        rows = _rows_by_rulings(ruled.down, width, height, top, bottom)
        if len(rows) < 3:
            lines = sorted({round(height - y) for y in levels if top - 5 <= height - y <= bottom + 5})
            gaps = _rows_by_gaps(inside)
            rows = lines if len(lines) >= 3 and len(lines) >= len(gaps) else gaps if len(gaps) >= 2 or len(lines) < 2 else lines
        if len(rows) < 2:
            middle = column_text(inside)
        else:
            left, texts = inside, []
            for a, b in zip(rows, rows[1:]):
                own = [i for i in left if a - 1 <= i.y <= b + 1]
                left = [i for i in left if not a - 1 <= i.y <= b + 1]
                texts.append(_row_text(own, bounds) if own else "")
            middle = "\n".join(t for t in [*texts, column_text(left).strip()] if t)
    return "\n".join(t for t in (column_text(above), middle, column_text(below)) if t.strip())


@dataclass
class Box:
    """An item with its extent."""

    item: Item
    x0: float
    y0: float
    x1: float
    y1: float


def boxed(item: Item) -> Box:
    return Box(item, item.x, item.y - 0.7 * item.size, item.x + max(1.0, len(item.text) * item.size * 0.55), item.y)


@dataclass
class Block:
    text: str
    x: float
    y: float
    right: float
    bottom: float
    size: float
    column: int = 0
    kind: str = ""


def _empty_runs(counts: Counter, first: int, last: int) -> list[tuple[int, int]]:
    """Runs of bins, 30 points wide at least, that hold next to nothing."""
    noise, runs, start = max(1, int(max(counts.values(), default=1) * 0.05)), [], None
    for b in range(first, last + 1):
        if counts[b] <= noise:
            start = b if start is None else start
        elif start is not None:
            runs.append((start, b))
            start = None
    if start is not None:
        runs.append((start, last))
    return [(a, b) for a, b in runs if b - a >= 3]


def two_columns(boxes: list[Box], width: float, height: float) -> tuple[float, float] | None:
    """The gap between two columns, if the page has them (L2)."""
    body = [b for b in boxes if 0.08 * height < b.y0 < 0.92 * height]
    lines = binned(body, lambda b: b.y0, 3)
    if len(body) < 10 or len(lines) < 6:
        return None
    starts = [min(b.x0 for b in g) for g in lines.values()]
    bins, first, last = int(width / 10) + 1, int(0.015 * width), int(0.085 * width)
    gaps = []
    for xs in (starts, [b.x0 for b in body]):
        gaps += _empty_runs(Counter(k for x in xs if 0 <= (k := int(x / 10)) < bins), first, last)
    gaps = [(10 * a, 10 * b, 10 * (b - a)) for a, b in gaps]
    share = lambda a, b: sum(a <= x.x0 <= b for x in body) / len(body)
    peaks = Counter(round(b.x0 / 10) * 10 for b in body).most_common()
    far = next((x for x, n in peaks[1:] if abs(x - peaks[0][0]) >= 0.15 * width and n >= 0.15 * peaks[0][1]), None)
    if far is not None:
        a, b = min(far, peaks[0][0]) + 20, max(far, peaks[0][0]) - 20
        if b > a and share(a, b) < 0.15:
            gaps.append((int(a / 10) * 10, int(b / 10) * 10, b - a))

    def valid(a: float, b: float) -> bool:
        left, right = sum(x.x0 < a for x in body), sum(x.x0 >= b for x in body)
        return b - a >= 0.12 * width and share(a, b) <= 0.15 and min(left, right) >= 0.2 * len(body)

    gaps = [g for g in gaps if valid(g[0], g[1])]
    if not gaps:
        return None
    left, right, _ = max(gaps, key=lambda g: g[2])
    several = [sorted(b.x0 for b in g) for g in lines.values() if len(g) >= 2]
    across = sum(x[0] < left and x[-1] > right and max(b - a for a, b in zip(x, x[1:])) < 0.5 * (right - left) for x in several)
    return None if len(several) > 5 and across > 0.5 * len(several) else (left, right)


def _split(line: list[Box], least: float, allowed: Callable[[float, float], bool]) -> int:
    """Where the widest gap between neighbours is, as the number of boxes before it; 0 if there is none."""
    steps = [(b.x0 - a.x0, k) for k, (a, b) in enumerate(zip(line, line[1:]), 1) if b.x0 - a.x0 >= least and allowed(a.x0, b.x0)]
    return max(steps, key=lambda s: (s[0], -s[1]))[1] if steps else 0


def assigned(boxes: list[Box], left: float, right: float) -> dict[int, list[Box]]:
    """Boxes of the whole width (0), the left (1) and the right column (2), line by line (L1)."""
    lines = [sorted(g, key=lambda b: b.x0) for g in binned(boxes, lambda b: b.y0, 3).values()]
    starts = Counter(round(g[0].x0 / 10) * 10 for g in lines if g[0].x0 >= right).most_common(1)
    least = 0.3 * (right - left)
    threshold = (starts[0][0] if starts else right) - least
    columns: dict[int, list[Box]] = {0: [], 1: [], 2: []}
    for line in lines:
        begin, end = line[0].x0, line[-1].x0
        if begin < left and end > right:
            cut = _split(line, least, lambda a, b: a < right and b > left)
        elif begin < left:
            cut = len(line)
        elif begin >= threshold:
            columns[2] += line
            continue
        else:
            cut = _split(line, least, lambda a, b: True)
        if cut:
            columns[1] += line[:cut]
            columns[2] += line[cut:]
        else:
            columns[0] += line
    return columns


def y_groups(boxes: list[Box]) -> list[list[Box]]:
    """Boxes by the merged intervals that they lie in, within two points."""
    spans: list[list[float]] = []
    for b in sorted(boxes, key=lambda b: b.y0):
        if spans and b.y0 <= spans[-1][1] + 4:
            spans[-1][1] = max(spans[-1][1], b.y1)
        else:
            spans.append([b.y0, b.y1])
    return [g for a, z in spans if (g := [b for b in boxes if a - 2 <= b.y0 <= z + 2])]


def _line(boxes: list[Box]) -> str:
    """A line's texts, a blank in gaps of over five points."""
    out, end = "", None
    for b in sorted(boxes, key=lambda b: b.x0):
        apart = end is not None and b.x0 - end > 5 and not out.endswith(" ") and not b.item.text.startswith(" ")
        out += (" " if apart else "") + b.item.text
        end = b.x1
    return out


def block(boxes: list[Box], column: int = 0) -> Block:
    """A block of the lines that its boxes make."""
    order = sorted(boxes, key=lambda b: (int(b.y0), b.x0))
    size = mean(b.item.size for b in boxes)
    lines = anchored(order, lambda b: b.y0, 0.6 * size)
    text = "\n".join(map(_line, lines)).replace("\0f\0", "fi").replace("\0l\0", "fl")
    text = re.sub(r"[\x00-\x08\x0b-\x1f]", "", text)
    return Block(text, min(b.x0 for b in boxes), min(b.y0 for b in boxes), max(b.x1 for b in boxes), max(b.y1 for b in boxes), size, column)


def interleaved(blocks: list[Block]) -> list[Block]:
    """Blocks of the whole width part the page; between them the left column, then the right (L3).

    Short ones that are no captions join the column that begins nearer to them.
    """
    by_y = lambda b: b.y
    left, right = (sorted((b for b in blocks if b.column == c), key=by_y) for c in (1, 2))
    full, tops = [], (left[0].y if left else None, right[0].y if right else None)
    for b in blocks:
        text = b.text.strip()
        if b.column or not text:
            continue
        if len(text) > 50 or text.lower().startswith(("figure", "table")) or not (left or right):
            full.append(b)
        elif left and (not right or abs(b.y - tops[0]) < abs(b.y - tops[1])):
            left.append(replace(b, column=1))
            tops = (min(tops[0], b.y), tops[1])
        else:
            right.append(replace(b, column=2))
            tops = (tops[0], min(tops[1], b.y))
    full.sort(key=by_y)
    left.sort(key=by_y)
    right.sort(key=by_y)
    out = []
    starts = [float("-inf"), *[f.y for f in full]]
    for k, (a, z) in enumerate(zip(starts, [*starts[1:], float("inf")])):
        out += full[k - 1 : k] if k else []
        out += [b for side in (left, right) for b in side if a <= b.y < z]
    return out


def ordered_by_threshold(blocks: list[Block], y: float) -> list[Block]:
    """The simple order: whole-width blocks above a height, the columns, whole-width blocks below (L4)."""
    place = {1: 1, 2: 2}
    return sorted(blocks, key=lambda b: (place.get(b.column, 0 if b.y < y else 3), b.y))


def merged(blocks: list[Block]) -> list[Block]:
    """Neighbours of one column, left edge and size become one."""
    out: list[Block] = []
    for b in blocks:
        a = out[-1] if out else None
        gap = b.y - a.bottom if a else 0
        if a and a.column == b.column and abs(b.x - a.x) < 20 and abs(b.size - a.size) < 4 and -5 < gap < 2 * a.size:
            a.text += ("\n\n" if gap > 1.2 * a.size else "\n") + b.text
            a.right, a.bottom = max(a.right, b.right), b.bottom
        else:
            out.append(replace(b))
    return out


def classified(blocks: list[Block], height: float) -> list[Block]:
    """Kinds of blocks by place, size and prefix."""
    usual = mean(b.size for b in blocks) if blocks else 0
    for b in blocks:
        if b.y < 0.08 * height:
            b.kind = "header"
        elif b.y > 0.92 * height:
            b.kind = "footer"
        elif b.size > 1.3 * usual:
            b.kind = "title" if b.size > 2 * usual else "heading"
        else:
            b.kind = "list" if b.text.startswith(("•", "-", "1.", "(1)")) else "paragraph"
    return blocks


def layout(items: list[Item], width: float, height: float) -> tuple[int, list[Block]]:
    """How many columns a page has, and its blocks in reading order."""
    boxes = list(map(boxed, items))
    gap = two_columns(boxes, width, height) if boxes else None
    if gap is None:
        blocks = sorted((block(g) for g in y_groups(boxes)), key=lambda b: b.y)
    else:
        blocks = interleaved([block(g, c) for c, own in assigned(boxes, *gap).items() for g in y_groups(own)])
    return 1 if gap is None else 2, classified(merged(blocks), height)


#: Ligatures that some fonts show as letters apart, and what closes, opens or parts words.
_SPACING = (
    (r"(?<=[^\W\d_]) (f) f i(?=[^\W\d_])", r"\1fi"), (r"(?<=[^\W\d_]) (f) f l(?=[^\W\d_])", r"\1fl"), (r"(?<=[^\W\d_]) (f) f (?=[^\W\d_])", r"\1f"),
    (r"(?<=[^\W\d_]) (f) ([il])(?=[^\W\d_])", r"\1\2"), (r"\s+([,.!?;:)\]}])", r"\1"), (r"\s*·\s*", "·"),
)


def spaced(text: str) -> str:
    for pattern, by in _SPACING:
        text = re.sub(pattern, by, text)
    return text


def page_text(items: list[Item], ruled: Ruled, width: float, height: float) -> str:
    """A page's text (P22): by ruled columns, else by layout, else as one column; ``items`` are top down."""
    if not items:
        return ""
    separator = column_separator(ruled.down, width)
    if separator is not None and ruled.across and not (len(ruled.down) > 10 * len(ruled.across) and len(ruled.across) < 15):
        inner = inner_boundaries(ruled, items, width, height)
        own = [(height - b, height - a) for x, a, b in ruled.down if abs(x - separator) < 5]
        top, bottom = min((t for t, _ in own), default=height), max((b for _, b in own), default=0.0)
        return spaced(ruled_text(items, inner if len(inner) >= 2 else [separator], ruled, width, height, (top, bottom) if bottom > top else None))
    if len(items) >= COLUMN_ITEMS:
        columns, blocks = layout(items, width, height)
        if columns >= 2 and blocks:
            return spaced("\n".join(b.text for b in blocks if b.text.strip()))
    return spaced(column_text(items))
