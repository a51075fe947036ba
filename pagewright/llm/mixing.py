"""Interleaving sources by target weights with Pfair windows under earliest-deadline-first.

A source of integer weight k among weights that sum to W gets the share k / W of the slots.  Its j-th block (from 0) is
released at floor(j * W / k) and due at ceil((j + 1) * W / k); giving each slot to the released block that is due first
keeps every source within less than one block of its share at every slot.  The schedule repeats after W slots, so one
period describes it.  When a source runs out, the others go on by their weights in a new phase.  Only the plan, one
row a source, is made on the driver; ranks, blocks and slots are DataFrame expressions.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.store import stored

BLOCK_DOCS = 16
#: Each source's documents are ranked in so many parts at least, and parts of about so many documents at most, so that no task ranks a whole source.
PARTS, PART_DOCS = 1024, 1 << 20
_PLAN = "array<struct<__s__ string, __phases__ array<struct<first bigint, slot bigint, k int, w int, at array<int>>>>>"


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(weights) slots."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    later = [(0, s, 0) for s in sorted(weights)]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    heapq.heapify(later)
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(slot)
        if j + 1 < weights[s]:
            heapq.heappush(later, ((j + 1) * total // weights[s], s, j + 1))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, int]) -> dict[str, list[dict]]:
    """For each source its phases: first block, first slot, weight, period and slots in a period."""
    left, done, start = dict(blocks), {s: 0 for s in blocks}, 0
    out: dict[str, list[dict]] = {s: [] for s in blocks}
    while left := {s: n for s, n in left.items() if n > 0}:
        own = {s: weights[s] for s in left}
        total, slots = sum(own.values()), period(own)
        end = min((n - 1) // own[s] * total + slots[s][(n - 1) % own[s]] for s, n in left.items()) + 1
        for s in list(left):
            out[s].append({"first": done[s], "slot": start, "k": own[s], "w": total, "at": slots[s]})
            took = end // total * own[s] + sum(at < end % total for at in slots[s])
            done[s] += took
            left[s] -= took
        start += end
    return out


def root_weights(counts: dict[str, int], power: float = 0.5, scale: int = 1000) -> dict[str, int]:
    """Integer weights in proportion to the counts to a power: small sources get more than their share."""
    total = sum(n**power for n in counts.values())
    return {s: max(1, round(scale * n**power / total)) for s, n in counts.items()}


def mix(df: DataFrame, weights: Callable[[dict[str, int]], dict[str, int]] = root_weights, block_docs: int = BLOCK_DOCS, parts: int | None = None) -> DataFrame:
    """Adds ``block`` (of its source), ``slot`` and ``position``, by which rows are to be ordered.

    ``weights`` maps the sources' document counts to integer weights; the counts, one row a source, are all that
    reaches the driver.  A null source is a source of its own.  Documents of a source come in the order of a hash of
    doc_id, then doc_id; rows that repeat an id lie side by side, and a null id hashes like any other.  Every row stays once; an empty table gives
    an empty one.  Input columns with the names of added ones are replaced.
    """
    df = df.drop("block", "slot", "position")
    parts = max(PARTS, -(-df.count() // PART_DOCS)) if parts is None else parts
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    keyed = df.withColumn("__s__", named).withColumn("__part__", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    counts = stored(keyed.groupBy("__s__", "__part__").agg(F.count("*").alias("__n__")), "part-counts")
    totals = {r["__s__"]: r["n"] for r in counts.groupBy("__s__").agg(F.sum("__n__").alias("n")).collect()}
    own = weights(totals)
    phases = plan({s: -(-n // block_docs) for s, n in totals.items()}, own)
    ties = [F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])]  # whichever task runs again
    before = Window.partitionBy("__s__").orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__s__", "__part__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__before__"))
    ranked = keyed.withColumn("__row__", F.row_number().over(Window.partitionBy("__s__", "__part__").orderBy("doc_id", *ties)) - 1)
    ranked = ranked.join(offsets, ["__s__", "__part__"])
    text = json.dumps([{"__s__": s, "__phases__": p} for s, p in phases.items()])
    table = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), _PLAN)))
    ranked = ranked.join(F.broadcast(table), "__s__")  # a row a source
    rank = F.col("__before__") + F.col("__row__")
    ranked = ranked.withColumn("__rank__", rank).withColumn("block", F.floor(F.col("__rank__") / block_docs))
    phase = F.element_at(F.filter("__phases__", lambda x: x["first"] <= F.col("block")), -1)
    ranked = ranked.withColumn("__p__", phase).withColumn("__j__", F.col("block") - F.col("__p__.first"))
    slot = F.col("__p__.slot") + F.expr("__j__ div __p__.k") * F.col("__p__.w") + F.expr("get(__p__.at, cast(__j__ % __p__.k as int))")
    ranked = ranked.withColumn("slot", slot).withColumn("position", F.col("slot") * block_docs + F.col("__rank__") % block_docs)
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], "block", "slot", "position")


def ordered(mixed: DataFrame) -> DataFrame:
    """Rows in the order of their position, file after file."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")


def numbered(written: DataFrame) -> DataFrame:
    """Adds ``position``, from 0, to the rows of ``ordered`` as read from its Parquet files, whose names keep the order.

    The reader packs files by size, so a row's place is that of its file by part and file number, then that in the file.
    Only the row counts of the files, one row a file, are in one place.
    """
    name = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).cast("long")
    rows = written.select(*[F.col(f"`{c}`") for c in written.columns], F.struct(*[F.coalesce(x, F.lit(0)) for x in name], "_metadata.file_name").alias("__file__"), F.col("_metadata.row_index").alias("__row__"))
    counts = rows.groupBy("__file__").agg(F.count("*").alias("__n__"))
    before = F.coalesce(F.sum("__n__").over(Window.orderBy("__file__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__file__", before.alias("__before__"))
    placed = rows.join(F.broadcast(offsets), "__file__")  # a row a file
    return placed.select(*[F.col(f"`{c}`") for c in written.columns if c != "position"], (F.col("__before__") + F.col("__row__")).alias("position"))
