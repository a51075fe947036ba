"""Positional operators over text items and rulings: lines, words, clusters, blocks, grids.

All group by (doc_id, page); ordered folds run over each page's sorted array, gaps and islands over windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def anchors(values: Column, tolerance: float) -> Column:
    """The firsts of sorted numbers' groups, each with all that lies within ``tolerance`` of its first."""
    empty = F.array().cast("array<double>")
    new = lambda found, y: (F.size(found) == 0) | (y - F.get(found, F.size(found) - 1) > tolerance)
    return F.aggregate(values, empty, lambda found, y: F.when(new(found, y), F.concat(found, F.array(y))).otherwise(found))


def lines(items: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Text lines of each page (P17): items within ``tolerance`` of a line's first, left to right, joined by blanks.

    One shuffle: a page's items meet once, and its lines are grouped where they are.
    """
    own = F.struct("y", "x", "seq", "text")
    held = items.groupBy(*PAGE).agg(F.collect_list(own).alias("items"))
    found = held.withColumn("anchors", anchors(F.array_sort(F.array_distinct(F.transform("items", lambda i: i["y"]))), tolerance))
    line = lambda i: F.size(F.filter("anchors", lambda a: a <= i["y"])) - 1
    placed = found.select(*PAGE, F.inline(F.transform("items", lambda i: F.struct(line(i).alias("line"), i["y"].alias("y"), i["x"].alias("x"), i["seq"].alias("seq"), i["text"].alias("text")))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "text"))), lambda i: i["text"]), " ")
    return placed.groupBy(*PAGE, "line").agg(F.min("y").alias("y"), text.alias("text"))


def clusters(values: DataFrame, tolerance: float = 4.0, least: int = 2) -> DataFrame:
    """1-D clusters by the gap to the previous value (D10): mean and size of those with ``least`` members."""
    by = Window.partitionBy(*PAGE).orderBy("v")
    new = F.when(F.col("v") - F.lag("v").over(by) > tolerance, 1).otherwise(0)
    numbered = values.withColumn("new", new).withColumn("cluster", F.sum("new").over(by))
    return numbered.groupBy(*PAGE, "cluster").agg(F.avg("v").alias("center"), F.count("*").alias("n")).where(F.col("n") >= least)


def merged_intervals(spans: DataFrame, gap: float = 0.0) -> DataFrame:
    """Intervals (lo, hi) of a page merged where they meet within ``gap``."""
    by = Window.partitionBy(*PAGE).orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("lo") > reach + gap, 1).otherwise(0))
    return spans.withColumn("island", F.sum("new").over(by)).groupBy(*PAGE, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def grid_cells(rulings: DataFrame, items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Items in the cells between successive rulings (D9): (doc_id, page, row, col, text).

    An item goes to the cell whose rulings lie at most ``tolerance`` behind it; rows and columns are looked up in the
    page's sorted rulings, so a page's items never meet its cells as a product.
    """
    places = lambda orient: F.array_sort(F.collect_set(F.when(F.col("orient") == orient, F.col("pos")))).alias(orient)
    bounds = rulings.groupBy(*PAGE).agg(places("h"), places("v"))
    at = lambda name, value: F.size(F.filter(name, lambda p: p - tolerance <= F.col(value))) - 1
    placed = items.join(bounds, PAGE).withColumn("row", at("h", "y")).withColumn("col", at("v", "x"))
    inside = (F.col("row").between(0, F.size("h") - 2)) & (F.col("col").between(0, F.size("v") - 2))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "seq", "text"))), lambda i: i["text"]), " ")
    return placed.where(inside).groupBy(*PAGE, "row", "col").agg(text.alias("text"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Order of blocks (L3): full-width ones (column 0) split the page into bands; left, then right, inside each.

    Blocks of equal y and seq come by column, then by all other columns that can be ordered; only equal rows are left.
    """
    key = ["y", "seq", "column"]
    key += [c for c, kind in blocks.dtypes if c not in (*PAGE, *key) and "map<" not in kind and "variant" not in kind]
    by = Window.partitionBy(*PAGE).orderBy(*[F.col(f"`{c}`") for c in key]).rowsBetween(Window.unboundedPreceding, 0)
    full = F.when(F.col("column") == 0, 1).otherwise(0)
    banded = blocks.withColumn("band", 2 * F.sum(full).over(by) - full)
    return banded.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "column", *[F.col(f"`{c}`") for c in key if c != "column"]))).drop("band")


def classify(blocks: DataFrame) -> DataFrame:
    """Kinds of blocks by place, size and prefix (L11); needs y, height (of the page), font_size and text."""
    mean = F.avg("font_size").over(Window.partitionBy(*PAGE))
    kind = (
        F.when(F.col("y") < 0.08 * F.col("height"), "header").when(F.col("y") > 0.92 * F.col("height"), "footer")
        .when(F.col("font_size") > 2 * mean, "title").when(F.col("font_size") > 1.3 * mean, "heading")
        .when(F.col("text").rlike(r"^(•|-|1\.|\(1\))"), "list").otherwise("paragraph")
    )
    return blocks.withColumn("block_type", kind)
