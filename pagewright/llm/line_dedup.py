"""Line deduplication through deletion neighbourhoods, in DataFrame operations only.

A line that is not blank goes if an earlier line, by (doc_id, text, line number), is within one edit of it.  Equal lines
collapse first, on hashes.  Two lines within one edit share their first or their last half, so only lines that share a
half with a different line go on; those emit all variants with one character deleted as hashed keys:

* equal variants of equally long lines, with the same position deleted, differ by one substitution;
* a variant equal to a whole shorter line differs by one insertion.

Lines of under ``near_chars`` characters go only as exact repeats: one edit of "p. 1" makes another line.

Keys are made chunk by chunk (hash before, chunk less a character, hash behind), so a line's work grows with its
length and not with its square.  Partners that share a key are verified by their edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.store import small, stored

CHUNK = 64
#: From this length on a line is long enough for one edit to be small.
NEAR_CHARS = 16


def _takes_part(line: Column, min_words: int) -> Column:
    word, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    return line.rlike(rf"(?:{word}+{space}+){{{min_words - 1}}}{word}")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, twin, line_no, line) of lines that take part; ``twin``, a hash of the text, tells apart rows that share an id."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("twin"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return parts.where(_takes_part(F.col("line"), min_words))


def _halves(line: Column) -> Column:
    n = F.length(line)
    short, long = F.ceil((n - 1) / 2).cast("int"), F.ceil(n / 2).cast("int")
    front = [F.xxhash64(F.lit(0), F.substring(line, F.lit(1), k)) for k in (short, long)]
    back = [F.xxhash64(F.lit(1), F.substring(line, n - k + 1, k)) for k in (short, long)]
    return F.array_distinct(F.array(*front, *back))


def _neighbours(lines: DataFrame) -> DataFrame:
    """(h, other): distinct lines and an earlier one with which each shares a variant; ``lines`` has h, pos and line."""
    n = F.length("line")
    chunks = lines.withColumn("n", n).withColumn("c", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / CHUNK).cast("int"))))
    at = F.col("c") * CHUNK

    def key(middle: Column, behind: Column) -> Column:
        before = F.xxhash64(F.substring("line", F.lit(1), at))
        return F.xxhash64(F.col("c"), before, middle, F.xxhash64(F.substring("line", behind, F.col("n"))))

    chunks = chunks.select(
        "h", "pos", "n", "c", F.substring("line", at + 1, F.lit(CHUNK)).alias("middle"),
        F.xxhash64(F.substring("line", F.lit(1), at)).alias("before"),
        F.xxhash64(F.substring("line", at + CHUNK + 1, F.col("n"))).alias("behind"),
        key(F.substring("line", at + 1, F.lit(CHUNK - 1)), at + CHUNK).alias("whole"),
    )
    deleted = chunks.where("middle <> ''").select("*", F.explode(F.sequence(F.lit(1), F.length("middle"))).alias("o"))
    less = F.concat(F.expr("substring(middle, 1, o - 1)"), F.expr("substring(middle, o + 1)"))
    deleted = deleted.select("h", "pos", "n", "o", F.xxhash64("c", "before", less, "behind").alias("key"))
    whole = chunks.select("h", "pos", "n", F.lit(0).alias("o"), F.col("whole").alias("key"))
    rows = deleted.unionByName(whole)
    me = F.struct("pos", "h")
    same, all_ = Window.partitionBy("key", "n", "o"), Window.partitionBy("key")
    rows = rows.select(
        "h", "pos", "o", F.min(me).over(same).alias("like"),
        F.min(F.when(F.col("o") > 0, F.struct("pos", "h", "n"))).over(all_).alias("longer"),
        F.min(F.when(F.col("o") == 0, F.struct("pos", "h", "n"))).over(all_).alias("shorter"),
    )
    others = F.array(
        F.when((F.col("o") > 0) & (F.col("like.pos") < F.col("pos")), F.col("like.h")),
        F.when((F.col("o") > 0) & (F.col("shorter.pos") < F.col("pos")), F.col("shorter.h")),
        F.when((F.col("o") == 0) & (F.col("longer.pos") < F.col("pos")), F.col("longer.h")),
    )
    return rows.select("h", F.explode(F.array_compact(others)).alias("other")).distinct()


def kept_lines(docs: DataFrame, min_words: int = 1, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, ``twin`` (the hash of the text) and ``kept``, the sorted numbers of its kept lines of at least ``min_words`` words."""
    lines = _lines(docs, min_words)
    halves = F.when(F.length("line") >= near_chars, _halves(F.col("line"))).otherwise(F.array().cast("array<bigint>"))
    hashed = lines.select(F.struct(F.xxhash64("line").alias("a"), F.hash("line").alias("b")).alias("h"), halves.alias("halves"), F.struct("doc_id", "twin", "line_no").alias("pos"))
    lone = stored(hashed.groupBy("h", "halves").agg(F.min("pos").alias("pos")), "lines")
    halves = lone.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("half")
    near = halves.join(shared, "half", "left_semi").select("h").distinct()
    near = stored(lone.join(near, "h", "left_semi").select("h", "pos", "pos.doc_id", "pos.twin", "pos.line_no"), "near-lines")
    side = F.broadcast(near) if small(near, 72) else near
    same = (lines.line_no == side.line_no) & (lines.twin == side.twin) & lines.doc_id.eqNullSafe(side.doc_id)
    texts = lines.join(side, same).select("h", "pos", "line")
    texts = stored(texts.dropDuplicates(["h"]), "near-texts")
    pairs = _neighbours(texts)
    pairs = pairs.join(texts.select("h", "line"), "h").join(texts.select(F.col("h").alias("other"), F.col("line").alias("earlier")), "other")
    gone = pairs.where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h").distinct()
    kept = lone.join(gone, "h", "left_anti")
    return kept.groupBy("pos.doc_id", "pos.twin").agg(F.sort_array(F.collect_list("pos.line_no")).alias("kept"))


def dedup(df: DataFrame, column: str = "text", min_words: int = 1, near_chars: int = NEAR_CHARS) -> DataFrame:
    """Replaces ``column`` by its text without removed lines; adds ``n_lines``, ``n_removed`` and ``emptied``.

    Blank lines stay and remove nothing, and so do lines of under ``min_words`` words, where more than one is asked for.
    Near lines go where both have ``near_chars`` characters.  A null doc_id comes before all others; rows that share an
    id but not the text are ordered by a hash of the text, and equal rows are one document: all get its result.  A null
    text stays null with no lines, and an empty table gives an empty one.  ``emptied`` marks documents of whose lines
    that take part none is left.  Other columns pass; input columns with the names of added ones are replaced.
    """
    df = df.drop("n_lines", "n_removed", "emptied")
    kept = kept_lines(df.select("doc_id", F.col(f"`{column}`").alias("text")), min_words, near_chars)
    kept = kept.select(F.col("doc_id").alias("__id__"), F.col("twin").alias("__twin__"), F.col("kept").alias("__kept__"))
    text = F.col(f"`{column}`")
    same = F.col("doc_id").eqNullSafe(F.col("__id__")) & (F.xxhash64(text) == F.col("__twin__"))
    joined = df.join(kept, same, "left").withColumn("__lines__", F.split(text, "\n", -1))
    numbers = F.sequence(F.lit(0), F.size("__lines__") - 1)
    others = F.filter(numbers, lambda i: ~_takes_part(F.get("__lines__", i), min_words))
    stay = F.array_sort(F.concat(F.coalesce("__kept__", F.array().cast("array<int>")), others))
    joined = joined.withColumn("__others__", F.size(others)).withColumn("__stay__", stay)
    left = F.array_join(F.transform("__stay__", lambda i: F.get("__lines__", i)), "\n")
    some = text.isNotNull()
    return joined.select(
        *[F.when(some, left).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns],
        F.when(some, F.size("__lines__")).otherwise(0).cast("long").alias("n_lines"),
        F.when(some, F.size("__lines__") - F.size("__stay__")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce(some & F.col("__kept__").isNull() & (F.size("__lines__") > F.col("__others__")), F.lit(False)).alias("emptied"),
    )
