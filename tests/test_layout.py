from collections import Counter, defaultdict

import duckdb

import __spark_entry__
from pagewright.operators import layout

SF = "/root/testdata/sf0.001"


def brute(blocks):
    pages = defaultdict(list)
    for doc, page, seq, col, y in blocks:
        pages[doc, page].append((y, seq, col))
    out = Counter()
    for (doc, page), own in pages.items():
        band, placed = 0, []
        for y, seq, col in sorted(own):
            band += 2 * (col == 0)
            placed.append((band - (col == 0), col, y, seq))
        for place, (_, col, y, seq) in enumerate(sorted(placed), 1):
            out[doc, page, seq, col, y, place] += 1
    return out


def test_reading_order_takes_every_page(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()
    want = brute((k % 50, k, n, p % 3, s % 60) for k, n, p, s in items)
    got = __spark_entry__.queries()["reading_order"](spark, SF).select("doc_id", "page", "seq", "col", "y", "place").collect()
    assert Counter(map(tuple, got)) == want and len(got) == len(items)
    with duckdb.connect() as db:
        db.execute(f"create view lineitem as from '{SF}/lineitem.parquet'")
        assert Counter(db.execute(__spark_entry__.oracle_sql()["reading_order"]).fetchall()) == want


def test_ties_do_not_depend_on_row_order(spark):
    rows = [(1, 1, 1, c, 5, t) for c in (2, 0, 1, 0) for t in "ba"]
    kinds = "doc_id int, page int, seq int, column int, y int, text string"
    found = [sorted(map(tuple, layout.reading_order(spark.createDataFrame(r, kinds)).collect()), key=lambda r: r[-1]) for r in (rows, rows[::-1])]
    assert found[0] == found[1] and [r[3] for r in found[0]] == [0, 0, 0, 0, 1, 1, 2, 2]
