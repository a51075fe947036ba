"""Sparse cells to dense grids, and grids to Markdown, CSV and TSV, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(cells: DataFrame, keys: list[str], first: int = 0) -> DataFrame:
    """Rows (keys, row, col, text) to one ``grid`` a key (R5, R11): missing cells are empty, collisions join by a blank."""
    cells = cells.groupBy(*keys, "row", "col").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    size = F.struct(F.max("row").alias("r"), F.max("col").alias("c")).alias("size")
    whole = cells.groupBy(*keys).agg(size, F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("at"))
    grid = F.transform(
        F.sequence(F.lit(first), F.col("size.r")),
        lambda r: F.transform(F.sequence(F.lit(first), F.col("size.c")), lambda c: F.coalesce(F.try_element_at("at", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))),
    )
    return whole.select(*keys, (F.col("size.r") - first + 1).alias("rows"), (F.col("size.c") - first + 1).alias("cols"), grid.alias("grid"))


def widened(grid: Column, width: Column | None = None) -> Column:
    """Rows padded with empty cells, and cut, to a width: by default that of the longest row."""
    width = F.array_max(F.transform(grid, F.size)) if width is None else width
    return F.transform(grid, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width))


def markdown(grid: Column) -> Column:
    """A pipe table with the first row as its header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rows = F.transform(grid, line)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def csv(grid: Column) -> Column:
    """Quoted where a comma, quote or line feed needs it."""
    cell = lambda x: F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, cell), ",")), "\n")


def tsv(grid: Column) -> Column:
    """Tab-separated lines."""
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "\t")), "\n")


def paragraphs_text(paragraphs: Column) -> Column:
    """Array of structs (text, heading_level) to text: blanks skipped, headings marked, empty lines between."""
    shown = F.filter(paragraphs, lambda p: F.trim(p["text"]) != "")
    mark = lambda p: F.when(p["heading_level"] > 0, F.concat(F.repeat(F.lit("#"), p["heading_level"]), F.lit(" "))).otherwise("")
    return F.array_join(F.transform(shown, lambda p: F.concat(mark(p), p["text"])), "\n\n")
