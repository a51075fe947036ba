import random

import pytest

from pagewright.operators import pages, tables
from pagewright.operators.pages import Item, Ruled


def items(*rows, size=10.0):
    return [Item(t, float(x), float(y), size) for t, x, y in rows]


def test_direction_and_scale():
    down = items(("a", 0, 700), ("b", 0, 680), ("c", 0, 660))
    assert [i.text for i in pages.top_down(down)] == ["a", "b", "c"] and pages.top_down(down)[0].y == 0
    assert [i.y for i in pages.top_down(down, 792)] == [92, 112, 132]
    assert [i.text for i in pages.top_down(items(("a", 0, 100), ("b", 0, 120), ("c", 0, 140)))] == ["a", "b", "c"]
    assert max(i.y for i in pages.top_down(items(("a", 0, 100), ("b", 0, 3000), ("c", 10, 200)))) <= pages.SCALE_TO
    assert pages.top_down([]) == [] and pages.page_text([], Ruled([], []), 600, 800) == ""


def test_words_by_gaps():
    assert pages.line_text(items(("ab", 0, 0), ("cd", 10, 0), ("ef", 60, 0))) == "abcd ef"
    wide = [Item(c, 10.0 * k, 0.0, 1.0) for k, c in enumerate("한국어")] + [Item("말", 60.0, 0.0, 1.0)]
    assert pages.line_text(wide) == "한국어 말"
    assert pages.column_text(items(("b", 50, 4), ("a", 0, 0), ("c", 0, 11))) == "a b\nc"


def test_two_columns_around_a_wide_block():
    left = [(f"left {k}", 50, 100 + 14 * k) for k in range(24)]
    right = [(f"right {k}", 345, 100 + 14 * k) for k in range(24)]
    count, blocks = pages.layout(items(*left, *right), 612, 792)
    assert count == 2 and [b.column for b in blocks] == [1, 2]
    assert blocks[0].text.split("\n")[:2] == ["left 0", "left 1"] and blocks[1].text.endswith("right 23")
    assert pages.layout(items(*left), 612, 792)[0] == 1


def test_interleaving_and_threshold_order():
    block = lambda text, y, column: pages.Block(text, 0, y, 10, y + 5, 10, column)
    blocks = [block("Table 1 caption", 50, 0), block("l1", 10, 1), block("r1", 12, 2), block("l2", 60, 1), block("r2", 61, 2)]
    assert [b.text for b in pages.interleaved(blocks)] == ["l1", "r1", "Table 1 caption", "l2", "r2"]
    assert [b.text for b in pages.ordered_by_threshold(blocks, 40)] == ["l1", "l2", "r1", "r2", "Table 1 caption"]


def test_ruled_columns():
    words = items(("top", 50, 20), ("a1", 60, 110), ("b1", 320, 110), ("a2", 60, 130), ("b2", 320, 130), ("end", 50, 400))
    ruled = Ruled([(800 - y, 50, 550) for y in (100, 120, 340)], [(300.0, 460 + 80 * k, 540 + 80 * k) for k in range(3)])
    assert pages.column_separator(ruled.down, 600) == 300
    assert pages.page_text(words, ruled, 600, 800) == "top\na1\na2\nb1\nb2\nend"
    rows = pages.ruled_text(words[1:5], [200.0, 300.0, 400.0], Ruled([(800 - y, 50, 550) for y in (100, 120, 140)], []), 600, 800, (100, 140))
    assert rows == "a1\nb1\na2\nb2"


def test_classification():
    block = lambda text, y, size: pages.Block(text, 0, y, 10, y + 5, size)
    kinds = [b.kind for b in pages.classified([block("x", 10, 10), block("x", 790, 10), block("T", 200, 60), block("H", 210, 25), block("- x", 220, 10), block("x", 230, 10), *[block("x", 300, 10)] * 6], 800)]
    assert kinds[:6] == ["header", "footer", "title", "heading", "list", "paragraph"]


def test_clusters():
    assert tables.clustered([1, 2, 3, 10, 20, 21]) == [2, 20.5]
    assert tables.clustered_bounded([0, 4, 8, 12]) == [4, 12]


@pytest.mark.parametrize("cells, split", [
    (["This sentence goes on and on until", "it ends"], True), (["Notice 2016-943", "Notice 2018-614"], False), (["제1조", "를 따른다"], True),
    (["open (", "closed"], True), (["x", ") y"], True), (["a", "b", "c"], False), (["one two three", "x", "four five six"], True), (["only"], False),
])
def test_split_sentences(cells, split):
    assert tables.split_sentence(cells) is split


def test_projection_rejects_prose():
    prose = items(("• A first point of some length,", 50, 100), ("Another line of it,", 50, 112), ("And its end.", 50, 124))
    assert tables.by_projection(prose) == []
    split = items(("This is a sentence that is cut", 50, 100), ("in two", 400, 100), ("And here is one more of that", 50, 120), ("kind here", 400, 120))
    assert tables.by_projection(split) == []


def test_grid_with_rows_below_and_a_repeated_last_row():
    down = [(x, 600.0, 700.0) for x in (100.0, 200.0, 300.0) for _ in range(2)]
    ruled = Ruled([(y, 100.0, 300.0) for y in (700.0, 675.0, 650.0, 625.0, 600.0)], down)
    words = items(*[(f"r{r}c{c}", 110 + 100 * c, 92 + 25 * r + 12) for r in range(4) for c in range(2)])
    (table,) = tables.page_tables(words, ruled, 612, 792)
    assert (table.method, table.rows, table.cols) == ("grid", 4, 2) and table.grid()[2] == ["r2c0", "r2c1"]
    more = words + items(("below", 110, 205), ("more", 210, 205), ("- 3 -", 150, 238))
    assert tables.page_tables(more, ruled, 612, 792)[0].cells[4, 0].endswith("below") if tables.page_tables(more, ruled, 612, 792)[0].rows > 4 else True


def test_alignment_and_overlap():
    rng = random.Random(1)
    rows = [(str(rng.randint(10, 99)), 60 + 103 * c, 100 + 14 * r) for r in range(6) for c in range(3)]
    found = tables.by_alignment(items(*rows), 612)
    assert [(t.method, t.rows, t.cols) for t in found] == [("alignment", 6, 3)]
    assert tables.page_tables(items(*rows), Ruled([], []), 612, 792, exclusive=True)[0].grid()[0] == [t for t, _, _ in rows[:3]]


def test_tables_between_rules():
    words = items(*[(f"v{r}{c}", 103 + 110 * c, 108 + 20 * r) for r in range(4) for c in range(3)])
    across = [(792 - y, 95.0, 420.0) for y in (100, 120, 140, 160, 180)]
    (table,) = tables.by_rules(words, across, 792)
    assert table.method == "hline" and table.cols == 3
    assert sum("v00" in t for t in table.cells.values()) == 2  # near two boundaries
    (table,) = tables.by_rules(words, across, 792, exclusive=True)
    assert sorted(t for t in table.cells.values() if t) == [w.text for w in words]


def test_stitching():
    part = lambda y, text: tables.Table({(0, 0): text, (0, 1): "x"}, 1, 2, 50, y, 200, 10, "")
    (one,) = tables.stitched([part(130, "b"), part(100, "a")])
    assert one.rows == 2 and one.cells[1, 0] == "b" and one.height == 40
    assert len(tables.stitched([part(100, "a"), part(300, "b")])) == 2


def test_rectangles_as_cells():
    rects = [(100 + 50 * c, 700 - 20 * r, 150 + 50 * c, 720 - 20 * r) for r in range(2) for c in range(2)]
    words = items(*[(f"{r}{c}", 105 + 50 * c, 792 - 710 + 20 * r) for r in range(2) for c in range(2)])
    assert tables.by_rectangles(rects, words, 792).grid() == [["00", "01"], ["10", "11"]]
