"""SimHash fingerprints and near-duplicate classes by pigeonring filtering.

Fingerprints are cut into ``RING`` segments in a ring.  If two differ in at most ``tau`` bits, some segment starts a
chain in which, for every length l, the first l segments differ in at most l * tau / RING bits (pigeonring
principle).  With 16 segments and 4 bits the first three of a chain agree and the first seven differ in one bit at
most, so one half of segments four to seven agrees as well: 20 agreeing bits make a join key, and the budgets of longer
chains prune pairs before the full Hamming distance.

Equal fingerprints are one node.  Nodes of a key that gathers over ``MOST_IN_GROUP`` are dealt on by longer keys: of
tau + 1 segments of the bits that are left one must agree, so no task takes an unbounded group and no link is lost.  Within groups, pairs of nodes already joined are skipped and only joining links leave the task.  Components come from
alternating star contraction over those links.

Texts of a five-word Jaccard similarity of 0.8 differ in about 10 of 64 bits, where lossless keys select little.  With a
``similarity``, texts of one shingle set are one node with a SimHash of ``WIDE`` bits in a ring: the signs of random
hyperplanes, taken through two rounds of random signs and Hadamard transforms.  A key is a segment that agrees, so many
segments that all but 1 of 10,000 pairs at exactly that similarity share one; the longer chain, ``CHAIN`` further bits of
the ring, has a budget of differing bits, and only an exact similarity of the shingle sets links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.store import dropped, small, stored

SEED = 42
RING = 16
WIDTH = 64 // RING
MOST_IN_GROUP = 8_192
WIDE, CHAIN = 4096, 128
#: Of the pairs at exactly the similarity asked for, the share that may have no segment in common.
MISSED = 1e-4
#: For 64-bit fingerprints of shingle sets with a similarity of 0.8: some five standard deviations over the mean.
SIMILAR_TAU = 24
_SIGNS = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (2, WIDE))
_HADAMARD = reduce(np.kron, [np.array([[1, 1], [1, -1]], np.float32)] * 6) / 8
SOLVE_BYTES = 64 << 20


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles, in order and with repeats."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    size = min(shingle, len(words))
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], ">u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    return _majority(_hashes(text, shingle))


def fingerprints(df: DataFrame, column: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col(f"`{column}`")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(first: int, count: int) -> int:
    """Mask of ``count`` segments of the ring from ``first`` on."""
    one = (1 << WIDTH) - 1
    return sum(one << (WIDTH * ((first + k) % RING)) for k in range(count))


def chain_masks(tau: int) -> dict[int, list[tuple[int, int]]]:
    """Key mask to (mask, budget) of the chain's longer prefixes.

    For tau = 4 the key is the three agreeing segments with either half of the next four; else the agreeing segments.
    """
    agree = next(n for n in range(RING + 1) if (n + 1) * tau // RING > 0 or n == RING)
    masks: dict[int, list[tuple[int, int]]] = {}
    for start in range(RING):
        prefixes = [(_segments(start, n), n * tau // RING) for n in range(agree + 1, RING)]
        prefixes = [p for p, q in zip(prefixes, [*prefixes[1:], (0, tau + 1)], strict=True) if q[1] > p[1]]
        once = sum(n * tau // RING == 1 for n in range(1, RING + 1))
        halves = [(0, once // 2), (once // 2, once - once // 2)] if once > 1 else [(0, 0)]
        for skip, take in halves:
            masks.setdefault(_segments(start, agree) | _segments(start + agree + skip, take), prefixes)
    return masks


def _joining(fp: np.ndarray, group: np.ndarray, mask: np.ndarray, chains: dict, tau: int) -> np.ndarray:
    """Links (pairs of rows) that join the nodes of each group; rows are sorted by group."""
    n = len(fp)
    end = np.searchsorted(group, group, side="right")
    roots = np.arange(n)
    links = []

    def find(i: int) -> int:
        while roots[i] != i:
            roots[i] = roots[roots[i]]
            i = roots[i]
        return i

    rows, step = np.arange(n), 1
    kinds, kind = np.unique(mask, return_inverse=True)
    prefixes = [chains.get(int(m), []) for m in kinds]
    budgets = []  # of each longer prefix of the chain: by row the mask and the most differing bits
    for k in range(max(map(len, prefixes), default=0)):
        own = [p[k] if k < len(p) else (0, tau) for p in prefixes]
        budgets.append((np.array([m for m, _ in own], np.uint64)[kind], np.array([b for _, b in own])[kind]))
    while len(rows := rows[rows + step < end[rows]]):
        apart = rows[roots[rows] != roots[rows + step]]
        differ = fp[apart] ^ fp[apart + step]
        for masks, most in budgets:
            near = np.bitwise_count(differ & masks[apart]) <= most[apart]
            apart, differ = apart[near], differ[near]
        apart = apart[np.bitwise_count(differ) <= tau]
        for i in apart:
            a, b = find(i), find(i + step)
            if a != b:
                roots[max(a, b)] = min(a, b)
                links.append((i, i + step))
        if len(apart):
            while True:
                up = roots[roots]
                if (up == roots).all():
                    break
                roots[:] = up
        step += 1
    return np.array(links, np.int64).reshape(-1, 2)


def longer_masks(mask: int, tau: int) -> list[int]:
    """Masks of longer keys: two values that agree under ``mask`` and differ in at most ``tau`` bits agree under one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= tau:
        return []
    cuts = [len(free) * i // (tau + 1) for i in range(tau + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def links(nodes: DataFrame, tau: int = 4, most: int = MOST_IN_GROUP) -> DataFrame:
    """(a, b) node pairs within ``tau`` bits that connect all that such pairs connect.

    ``nodes`` has node and fp, both distinct.  Keys of over ``most`` nodes are dealt on by longer keys, again and again.
    """
    chains = chain_masks(tau)
    masks = F.array(*[F.lit(_signed(m)) for m in chains])
    level = nodes.select("node", "fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    found = []
    while True:
        crowds = stored(level.groupBy("mask", "part").count().where(F.col("count") > most).drop("count"), "crowds")
        longer = [(_signed(m), _signed(x)) for r in crowds.select("mask").distinct().collect() for m in (r["mask"] & (1 << 64) - 1,) for x in longer_masks(m, tau)]  # a few a mask
        if not longer:
            return reduce(DataFrame.unionAll, [*found, _pairs(level, chains, tau)]).distinct()
        split = F.broadcast(nodes.sparkSession.createDataFrame(longer, "mask bigint, longer bigint"))
        ended = F.broadcast(nodes.sparkSession.createDataFrame([(m,) for m in sorted({m for m, _ in longer})], "mask bigint"))
        crowds = crowds.join(ended, "mask", "left_semi")
        found.append(_pairs(level.join(crowds, ["mask", "part"], "left_anti"), chains, tau))
        inside = level.join(crowds, ["mask", "part"], "left_semi").join(split, "mask")
        level = stored(inside.select("node", "fp", F.col("longer").alias("mask"), F.col("fp").bitwiseAND(F.col("longer")).alias("part")).distinct(), "crowded")


def _pairs(keyed: DataFrame, known: dict, tau: int) -> DataFrame:
    """Joining links within each (mask, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 500_000:  # groups may run on: keep the last one
                yield from solve(held, False)
                size = sum(b.num_rows for b in held)
        yield from solve(held, True)

    def solve(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        node, fp, mask, part = (whole[c].to_numpy() for c in ("node", "fp", "mask", "part"))
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        stop = len(fp) if last or not len(cut) else int(cut[-1])
        if not last:
            if not len(cut):
                stop = 0
            held.extend(whole.slice(stop).to_batches())
        if not stop:
            return
        group = np.zeros(stop, np.int64)
        group[cut[cut < stop]] = 1
        fps, masks = fp[:stop].view(np.uint64), mask[:stop].view(np.uint64)
        group = np.cumsum(group)
        alone = np.bincount(group)[group] < 2
        node, fps, masks, group = (x[: len(alone)][~alone] for x in (node, fps, masks, group))
        found = _joining(fps, group, masks, known, tau)
        yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

    dealt = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node reaches, by alternating large and small stars."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(_hashes(text, shingle).astype(np.uint64))


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHashes of ``WIDE`` bits of some shingle sets, as rows of bytes."""
    sums = np.empty((len(sets), WIDE), np.float32)
    for i, hashes in enumerate(sets):
        sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float64)
        sums[i] = np.bincount((hashes % np.uint64(WIDE)).astype(np.int64), sign, WIDE)
    for signs in _SIGNS:  # the Hadamard matrix of WIDE rows is the product of two of 64
        sums = (_HADAMARD @ (sums * signs).reshape(-1, 64, 64) @ _HADAMARD).reshape(-1, WIDE)
    return np.packbits(sums > 0, axis=1)


def _sketches(df: DataFrame, column: str, shingle: int) -> DataFrame:
    """doc_id, ``whole`` (the hash of the shingle set), ``print`` of the set, null of an empty one, and ``fp``, its first 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)[at : at + 256]]
                whole = [_signed(xxhash.xxh64_intdigest(x, SEED)) for x in sets]
                prints = wide_prints(sets)
                fp = np.ascontiguousarray(prints[:, :8]).view(np.int64)[:, 0]
                own = [p.tobytes() if len(x) else None for p, x in zip(prints, sets, strict=True)]
                columns = [batch.column(0)[at : at + 256], pa.array(whole, pa.int64()), pa.array(fp), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "whole", "fp", "print"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col(f"`{column}`")).mapInArrow(run, f"doc_id {kind}, whole bigint, fp bigint, print binary")


def segments(count: int, similarity: float) -> tuple[int, int, int]:
    """For so many nodes: bits of a segment, how many segments are keys, and the most differing bits of the chain behind."""
    apart = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi  # of sets of equal size; others differ less
    bits = min(24, max(8, count.bit_length() - 6))  # some 50 unrelated nodes a key, whatever their number
    keys = ceil(log(MISSED) / log(1 - min((1 - apart) ** bits, 0.9)))
    return bits, keys, ceil(CHAIN * apart + 5 * sqrt(CHAIN * apart * (1 - apart)))


def ring_keys(prints: np.ndarray, bits: int, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some prints (rows of bytes), a row each, and the chains behind as two words."""
    ring = np.unpackbits(prints, axis=1)
    ring = np.concatenate([ring, ring[:, : bits + CHAIN]], axis=1)
    power = 1 << np.arange(bits, dtype=np.int64)
    found, chains = np.empty((len(prints), keys), np.int64), np.empty((len(prints), keys, CHAIN // 64), np.uint64)
    for k in range(keys):
        at = k * WIDE // keys
        found[:, k] = ring[:, at : at + bits] @ power + (k << 32)
        chains[:, k] = np.packbits(ring[:, at + bits : at + bits + CHAIN], axis=1).view(np.uint64)
    return found, chains


def _near(chains: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The first row that each row reaches in its group by chains that differ in ``most`` bits or less; rows are sorted by group."""
    end = np.searchsorted(group, group, side="right")
    roots, rows, step = np.arange(len(group)), np.arange(len(group)), 1

    def find(i: int) -> int:
        while roots[i] != i:
            roots[i] = roots[roots[i]]
            i = roots[i]
        return i

    while len(rows := rows[rows + step < end[rows]]):
        apart = rows[roots[rows] != roots[rows + step]]
        apart = apart[np.bitwise_count(chains[apart] ^ chains[apart + step]).sum(1) <= most]
        for i in apart:
            a, b = find(i), find(i + step)
            roots[max(a, b)] = min(a, b)
        while len(apart):
            up = roots[roots]
            if (up == roots).all():
                break
            roots[:] = up
        step += 1
    return roots


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int, size) -> Iterator[pa.Table]:
    """Runs of rows of about ``most`` by ``size`` of a batch; rows that share a key stay together."""
    held: list[pa.RecordBatch] = []
    so_far = 0
    for batch in batches:
        held.append(batch)
        so_far += size(batch)
        if so_far >= most:  # groups may run on: keep the last one
            whole = pa.Table.from_batches(held)
            key = whole["key"].to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(cut):
                yield whole.slice(0, cut[-1])
                held = whole.slice(cut[-1]).to_batches()
                so_far = sum(size(b) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def close_groups(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node): groups of nodes that share a segment and whose chains link them; ``nodes`` has node and print."""
    bits, keys, most = segments(nodes.count(), similarity)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                node = batch.column(0)[at : at + 1000].to_numpy()
                prints = np.frombuffer(b"".join(batch.column(1)[at : at + 1000].to_pylist()), np.uint8).reshape(-1, WIDE // 8)
                found, chains = ring_keys(prints, bits, keys)
                columns = [found.reshape(-1), np.repeat(node, keys), *chains.view(np.int64).reshape(-1, CHAIN // 64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "node", "one", "two"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 250_000, lambda b: b.num_rows):
            key, node, one, two = (rows[c].to_numpy() for c in ("key", "node", "one", "two"))
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            roots = _near(np.stack([one, two], 1).view(np.uint64), group, most)
            some = np.flatnonzero(np.bincount(roots, minlength=len(roots))[roots] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(node[roots[some]]), pa.array(node[some])], names=["key", "root", "node"])

    rows = nodes.select(F.col("node").cast("bigint"), "print").mapInArrow(keyed, "key bigint, node bigint, one bigint, two bigint")
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(grouped, "key bigint, root bigint, node bigint")
    return found.select(F.xxhash64("key", "root").alias("key"), "node")


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    """``whole`` and ``hashes``, the shingle set, of each row's second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)[at : at + 1000]]
                whole = [_signed(xxhash.xxh64_intdigest(x, SEED)) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int64()), pa.array(sets, pa.binary())], names=["whole", "hashes"])

    return df.mapInArrow(run, "whole bigint, hashes binary")


def _similar(fp: np.ndarray, sets: list[np.ndarray], tau: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join what pairs of at least ``similarity`` join; pairs already joined are skipped."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    label, mark, found = np.arange(n), np.zeros(ids.max() + 1, bool), []
    for i in range(n - 1):
        js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        js = js[(np.bitwise_count(fp[js] ^ fp[i]) <= tau) & (np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]))]
        if not len(js):
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        if len(js) > n // 8:
            common = np.add.reduceat(mark[ids], starts[:-1], dtype=np.int64)[js]
        else:
            common = np.array([mark[ids[starts[j] : starts[j + 1]]].sum() for j in js])
        mark[own] = False
        js = js[common >= similarity * (sizes[js] + sizes[i] - common)]
        labels, first = np.unique(label[js], return_index=True)
        found += [(i, int(j)) for j in js[first]]
        label[np.isin(label, labels)] = label[i]
    return found


def _similar_links(nodes: DataFrame, df: DataFrame, tau: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b) node pairs of at least ``similarity``; ``nodes`` has node, whole, fp and print, ``df`` doc_id and text."""
    keyed = stored(close_groups(nodes.where("print is not null"), similarity), "close")
    one, two = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))
    groups = groups.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")  # of groups with the same members, one
    members = stored(keyed.join(groups, "key", "left_semi"), "members")
    wanted = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "whole", "fp"), "candidates")
    side = F.broadcast(wanted) if small(wanted, 48) else wanted
    texts = df.join(side.select("node"), F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text")
    sets = stored(_sets(texts, shingle).join(side, "whole").dropDuplicates(["whole"]), "shingle-sets")
    rows = members.join(sets, "node").select("key", "node", "fp", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, SOLVE_BYTES, lambda b: b.nbytes):
            key, node, fp = (rows[c].to_numpy() for c in ("key", "node", "fp"))
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cut, cut[1:]):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"].slice(a, b - a)]
                found = _similar(fp[a:b].view(np.uint64), own, tau, similarity)
                if found:
                    pairs = node[a:b][np.array(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, column: str = "text", tau: int = 4, shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """One row a document: doc_id, ``fp`` and ``component_id``, the least doc_id that links of at most ``tau`` bits reach.

    Null and empty texts have fingerprint 0 and link like any other.  A null doc_id takes part through its fingerprint
    only; if no document of a component has an id, component_id is null.  Repeated rows stay, each with its result.

    With ``similarity``, a link is a Jaccard similarity of the shingle sets of at least that; ``fp`` is then the set's,
    and texts without words link to each other only.
    """
    if similarity is not None:
        docs = df.select("doc_id", F.col(f"`{column}`").alias("text"))
        prints = stored(_sketches(docs, "text", shingle), "sketches")
        nodes = stored(prints.groupBy("whole").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("print").alias("print")), "nodes")
        joined = components(_similar_links(nodes.where("node is not null"), docs, tau, shingle, similarity))
        roots = nodes.join(joined, "node", "left").select("whole", F.coalesce("root", "node").alias("component_id"))
        return prints.join(roots, "whole").select("doc_id", "fp", "component_id")
    prints = stored(fingerprints(df, column, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    joined = components(links(nodes.where("node is not null"), tau))
    roots = nodes.join(joined, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp"):
    """A signed fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
