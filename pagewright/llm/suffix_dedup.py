"""Exact substring dedup: bytes covered by a ``length``-byte string that also starts earlier go.

The suffixes to sort are found first.  Winnowing picks, by content alone, an anchor in every string of ``length``
bytes, so equal strings hold equal anchors at equal places.  Each anchor travels as a hash with a hash of its context,
the bytes of the strings that chose it.  Equal contexts collapse to the earliest; of an anchor with several
contexts those earliest ones send their bytes.  Their suffixes are ordered by deep-shallow sorting: multikey
quicksort, eight bytes a step, to a shallow depth, then a blind trie for each group that still agrees.  The tries keep
branching places alone and grow together, a level at a time.  Equal strings are neighbours in the suffix order; all but
the earliest are covered.

An anchor with very many contexts sends single strings dealt by their own hash, so no group meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bytewise as bw
from pagewright.llm.mixing import numbered
from pagewright.llm.store import dropped, stored

LENGTH = 100
GRAM = 32
SHALLOW = 24
#: Contexts from which an anchor's strings are dealt one by one.
CROWD = 2_000
FULL, EDGE, SINGLE, SENT = 0, 1, 2, 9
NO_ID = -(1 << 63)
#: Bytes of contexts that are sorted at once, and bytes of strings that a task gathers before it sends them.
SORT_BYTES = 4 << 20
SEND_BYTES = 16 << 20
#: A place and the bytes of its context before and after it, in one number.
SPAN_BITS = 12
#: Bytes of texts for which a range of anchors' hashes is kept apart, so a range does not grow with the input.
PART_BYTES = 32 << 20
_DONE = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_SPREAD = "kind int, part int, doc_id bigint, text binary, spans binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _sliding(x: np.ndarray, w: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) of each w consecutive values, in a constant number of passes."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, x[-1], x.dtype)]).reshape(-1, w)
    ahead = take.accumulate(padded, axis=1).reshape(-1)
    behind = take.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return take(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(document, place, context's begin and end, anchor's hash, context's hash) of the anchors; places in the block.

    A string's anchor is the leftmost of its grams with the least upper half of a hash.
    """
    n, w = len(data), length - gram + 1
    stop = np.repeat(offsets[1:], np.diff(offsets))
    inside = np.flatnonzero(np.arange(n - length + 1) + length <= stop[: n - length + 1]) if n >= length else np.zeros(0, np.int64)
    if not len(inside):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    spans = bw.Words(data, offsets, None, None, None)
    at = np.arange(n - gram + 1)
    hashes = spans.span_hash(at, at + gram)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    chosen = (_sliding(keys, w, np.minimum)[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    place, begin, end = chosen[new], inside[new], inside[np.append(new[1:] - 1, len(inside) - 1)] + length
    doc = np.searchsorted(offsets, place, side="right") - 1
    context = bw.mix(spans.span_hash(begin, end) + ((place - begin) * 4096 + (end - place)).astype(np.uint64))
    return doc, place, begin, end, hashes[place], context


def _coded(place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return place << (2 * SPAN_BITS) | (place - begin) << SPAN_BITS | (end - place)


def _decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, begin, end)"""
    low, place = (1 << SPAN_BITS) - 1, code >> (2 * SPAN_BITS)
    return place, place - (code >> SPAN_BITS & low), place + (code & low)


def _known(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _found(parts: int, length: int, gram: int):
    """Anchors by range of hashes: packed (anchor, context, doc_id, place in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
        for batch in batches:
            ids = _known(batch.column(0))
            for first, last, data, offsets in bw.blocks(batch.column(1)):
                doc, place, begin, end, anchor, context = anchors(data, offsets, length, gram)
                own, place = ids[first:last][doc], _coded(place - offsets[doc], begin - offsets[doc], end - offsets[doc])
                order = np.lexsort((place, own, context, anchor))
                anchor, context, own, place = anchor[order], context[order], own[order], place[order]
                later = np.zeros(len(anchor), bool)  # in this block: the same anchor and context, strictly earlier
                head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])) if len(anchor) else np.zeros(0, int)
                lead = np.repeat(head, np.diff(np.append(head, len(anchor))))
                later = (own != own[lead]) | (place != place[lead])
                yield _places(own[later], place[later], np.full(int(later.sum()), FULL, np.int32))
                anchor, context, own, place = (x[~later] for x in (anchor, context, own, place))
                cuts = [0, *np.searchsorted(anchor, edges).tolist(), len(anchor)]
                rows = [(p, *[bw.pack(x[i:j]) for x in (anchor, context, own, place)]) for p, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield _row(part=pa.array(cols[0], pa.int32()), anchor=cols[1], context=cols[2], own=cols[3], place=cols[4])

    return run


_FOUND = {"part": pa.int32(), "anchor": pa.binary(), "context": pa.binary(), "own": pa.binary(), "place": pa.binary(), "doc_id": pa.int64(), "at": pa.int64(), "kind": pa.int32()}
_FOUND_SQL = "part int, anchor binary, context binary, own binary, place binary, doc_id bigint, at bigint, kind int"


def _row(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in _FOUND.items()], names=list(_FOUND))


def _places(own, place, kind) -> pa.RecordBatch:
    return _row(doc_id=own, at=place.astype(np.int64), kind=kind)


def _resolved(crowd: int):
    """All anchors of a range of hashes: which repeat an earlier context, and which must send theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], [], []]
        for batch in batches:
            for k, name in enumerate(("anchor", "context", "own", "place")):
                got[k] += [bw.unpack(x.as_py()) for x in batch.column(name)]
        if not got[0]:
            return
        anchor, context, own, place = map(np.concatenate, got)
        got.clear()
        order = np.lexsort((place, own, context, anchor))
        anchor, context, own, place = anchor[order], context[order], own[order], place[order]
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        head = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
        heads = np.flatnonzero(head)
        lead = np.repeat(heads, np.diff(np.append(heads, len(anchor))))
        later = (own != own[lead]) | (place != place[lead])
        contexts = np.bincount(np.cumsum(new_anchor) - 1, weights=head)[np.cumsum(new_anchor) - 1]
        kind = np.where(later, FULL, np.where(contexts > crowd, SINGLE, EDGE)).astype(np.int32)
        sent = later | (contexts > 1)
        for i in range(0, int(sent.sum()), 200_000):
            at = np.flatnonzero(sent)[i : i + 200_000]
            yield _places(own[at], place[at], kind[at])

    return run


def _merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The union of spans as rows of (start, end)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return np.stack([starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]], 1)


def _cut(text: bytes, spans: np.ndarray, whole: bool) -> tuple:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    left = b"".join([*kept, text[at:]])
    return len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if whole else None


def _spread(parts: int, length: int, gram: int, whole: bool):
    """With its places at hand a document is done, or waits and sends the contexts that must be compared."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _SPREAD.split(", ")]

    def key_of(piece: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(piece, digest_size=7).digest(), "little")

    def packed(rows: list, sent: list) -> Iterator[pa.RecordBatch]:
        # Contexts with equal bytes: of those at hand the earliest stands for all, and the later ones are covered.
        first: dict[bytes, tuple] = {}
        for key, own, begin, piece in sorted(sent, key=lambda x: x[1:3]):
            lead = first.setdefault(piece, (own, begin, key))
            if lead[:2] != (own, begin):
                rows.append((SINGLE, None, own, None, None, begin, begin + len(piece), None, None, None))
        groups: dict[int, list] = {}
        for piece, (own, begin, key) in first.items():
            groups.setdefault(key % parts, []).append((own, begin, key // parts, piece))
        for part, own in groups.items():
            body = bw._C.compress(b"".join(x[3] for x in own))
            rows.append((SENT, part, None, body, np.array([(a, b, len(c), k) for a, b, k, c in own], np.int64).tobytes(), None, None, None, None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sent, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i] for k in ("doc_id", "text", "full", "edge", "single")}
                text, doc_id = r["text"].as_py() or b"", r["doc_id"].as_py()
                own = NO_ID if doc_id is None else doc_id
                full, edge, single = (np.sort(r[k].values.to_numpy()) if r[k].is_valid else np.zeros(0, np.int64) for k in ("full", "edge", "single"))
                _, begin, end = _decoded(full)
                order = np.argsort(begin, kind="stable")
                spans = _merged(begin[order], np.minimum(end[order], len(text)))
                size += len(text)
                if not len(edge) and not len(single):
                    rows.append((FULL, None, doc_id, None, None, *_cut(text, spans, whole)))
                else:
                    rows.append((EDGE, None, doc_id, text, spans.tobytes(), None, None, None, None, None))
                for p, a, b in zip(*(x.tolist() for x in _decoded(edge)), strict=True):
                    sent.append((key_of(text[p : p + gram]), own, a, text[a:b]))
                    size += b - a
                for _, a, b in zip(*(x.tolist() for x in _decoded(single)), strict=True):
                    sent += [(key_of(text[q : q + length]), own, q, text[q : q + length]) for q in range(a, b - length + 1)]
                    size += (b - a - length + 1) * length
                    if size > SEND_BYTES:
                        yield from packed(rows, sent)
                        rows, sent, size = [], [], 0
                if size > SEND_BYTES:
                    yield from packed(rows, sent)
                    rows, sent, size = [], [], 0
        yield from packed(rows, sent)

    return run


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, length: int) -> np.ndarray:
    """Where the strings at a and b first differ, if they agree to ``depth``; ``length`` if nowhere."""
    place = np.full(len(a), length)
    left, at = np.arange(len(a)), np.minimum(depth, length - 8)
    while len(left):
        x = words[a[left] + at].astype(np.uint64) ^ words[b[left] + at].astype(np.uint64)
        differ = x != 0
        found = x[differ]
        place[left[differ]] = at[differ] + sum((found < np.uint64(1 << k)).astype(np.int64) for k in range(8, 64, 8))
        on = ~differ & (at < length - 8)
        left, at = left[on], np.minimum(at[on] + 8, length - 8)
    return place


def _heads(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _dealt(live: np.ndarray, start: np.ndarray, kind: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """One stable step of a partition sort: every group by its members' small ``kind``; returns the new order and starts.

    Members of a group stand together, in the order of their group's start in the suffix order.
    """
    heads = _heads(start)
    size = np.diff(np.append(heads, len(live)))
    head = np.repeat(heads, size)
    to, begin = np.empty(len(live), np.int64), head.copy()
    for k in range(kinds):
        own = kind == k
        before = np.cumsum(own)
        rank = before - own - (before[head] - own[head])
        to[own] = (begin + rank)[own]
        begin += np.repeat(np.add.reduceat(own.astype(np.int64), heads), size)
    order = np.empty(len(live), np.int64)
    order[to] = np.arange(len(live))
    kind, start, head = kind[order], start[order], head[order]
    new = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (kind[1:] != kind[:-1])]))
    return order, np.repeat(start[new] + new - head[new], np.diff(np.append(new, len(live))))


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, length: int, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ternary quicksort of all groups at once, eight bytes a step, to the shallow depth.

    Returns the start of each string's group in the suffix order, the strings whose groups still agree, and to what
    depth.  A group's pivot is the word of its middle member; those that equal it go on with the next word.
    """
    place = np.zeros(len(starts), np.int64)
    live, start, deep = np.arange(len(starts)), place.copy(), np.zeros(len(starts), np.int64)
    agree: list[np.ndarray] = []
    while len(live):
        heads = _heads(start)
        size = np.diff(np.append(heads, len(live)))
        word = words[starts[live] + deep].astype(np.uint64)
        pivot = np.repeat(word[heads + size // 2], size)
        kind = (word >= pivot).astype(np.int8) + (word > pivot)
        order, start = _dealt(live, start, kind, 3)
        live, deep = live[order], deep[order] + 8 * (kind[order] == 1)
        place[live] = start
        alone = np.bincount(np.cumsum(np.concatenate([[True], start[1:] != start[:-1]])) - 1)
        alone = np.repeat(alone == 1, alone)
        ended = (deep + 8 > min(shallow, length)) & ~alone
        agree.append(live[ended])
        live, start, deep = (x[~alone & ~ended] for x in (live, start, deep))
    left = np.concatenate([np.zeros(0, np.int64), *agree])
    return place, left, np.full(len(left), min(shallow, length) // 8 * 8)


def blind_tries(words: np.ndarray, data: np.ndarray, starts: np.ndarray, start: np.ndarray, deep: np.ndarray, length: int) -> np.ndarray:
    """The start in the suffix order of each leaf under a trie for each group of strings that agree to ``deep``.

    A node keeps its branching place alone, where a member first differs from the node's first, and its children are
    dealt by that byte.  All nodes of a level are split at once; a node without such a place is a leaf of equal strings.
    """
    place = start.copy()
    live = np.argsort(start, kind="stable")
    start, deep = start[live], deep[live]
    while len(live):
        heads = _heads(start)
        size = np.diff(np.append(heads, len(live)))
        differ = _first_difference(words, starts[live], starts[np.repeat(live[heads], size)], deep, length)
        branch = np.repeat(np.minimum.reduceat(differ, heads), size)
        place[live] = start
        on = branch < length
        live, start, branch = live[on], start[on], branch[on]
        byte = data[starts[live] + branch]
        order = np.lexsort((byte, start))
        group = start
        live, deep, byte = live[order], branch[order] + 1, byte[order]
        head = np.searchsorted(group, group)
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (byte[1:] != byte[:-1])])[: len(live)])
        start = np.repeat(group[new] + new - head[new], np.diff(np.append(new, len(live))))
    return place


def deep_shallow(buffer: bytes, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """The place in sorted order of each of the ``length``-byte strings (8 bytes or more) at ``starts``.

    Equal strings share the place of their first; a stable sort by place is the suffix order.
    """
    data = np.frombuffer(buffer, np.uint8)
    if not len(starts):
        return np.zeros(0, np.int64)
    words = np.ndarray((len(data) - 7,), ">u8", buffer, strides=(1,))  # the eight bytes from every byte on
    place, left, deep = multikey_quicksort(words, starts, length, max(shallow, 8))
    if len(left):
        place[left] = blind_tries(words, data, starts[left], place[left], deep, length)
    return place


def _covered(head: np.ndarray, base: np.ndarray, buffer: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, begin, end) of what later strings of these contexts cover."""
    many = head[:, 2] - length + 1
    which = np.repeat(np.arange(len(head)), many)
    step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    group = deep_shallow(buffer, base[which] + step, length)
    again = np.flatnonzero(np.bincount(group)[group] > 1)
    group, own, at = group[again], head[which[again], 0], head[which[again], 1] + step[again]
    order = np.lexsort((at, own, group))  # in suffix order, equal strings by their place in the input
    group, own, at = group[order], own[order], at[order]
    if not len(group):
        return (np.zeros(0, np.int64),) * 3
    heads = _heads(group)
    lead = np.repeat(heads, np.diff(np.append(heads, len(group))))
    later = (own != own[lead]) | (at != at[lead])
    own, at = own[later], at[later]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    if not len(own):
        return own, at, at
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] > at[:-1] + length)])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)
    return own[new], at[new], at[last] + length


def _compared(length: int):
    """Covered spans of the contexts of a part, by ordering their suffixes, those of some anchors at a time."""

    def run(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in table["spans"]]
        head, buffer = np.concatenate(heads), b"".join(bw._D.decompress(x.as_py()) for x in table["text"])
        base = np.concatenate([[0], np.cumsum(head[:, 2])[:-1]])
        turns = -(-len(buffer) // SORT_BYTES)
        turn = head[:, 3] % max(turns, 1)
        found = [_covered(head[own], base[own], buffer, length) for own in (np.flatnonzero(turn == k) for k in range(turns)) if len(own)]
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in zip(*found, strict=True)], names=["doc_id", "a", "b"])

    return run


def _finished(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = np.frombuffer(r["spans"], np.int64).reshape(-1, 2)
                more = np.array([(x["a"], x["b"]) for x in r["more"] or []], np.int64).reshape(-1, 2)
                both = np.concatenate([base, more])
                rows.append((r["doc_id"], *_cut(r["text"], _merged(both[:, 0], both[:, 1]), whole)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _DONE.split(", ")])

    return run


def dedup(df: DataFrame, column: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """Returns doc_id (integer), n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, the bytes ``kept``.

    Texts count as UTF-8 bytes; null is empty.  Earlier means a smaller doc_id, or the same and an earlier start; null
    ids come first.  Rows that share an id but not the text are ordered by a hash of the text; equal rows (with one id
    and one text) are one document, so they do not remove each other and all get its result.  An empty table gives an
    empty one.
    """
    if not 8 <= length < 1 << SPAN_BITS or not 1 <= gram <= length:
        raise ValueError("strings have 8 to 4095 bytes, and hold a gram")
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{column}`").cast("binary").alias("text"))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.min("doc_id")).first()
    if (ids[0] or 0) < 2 and ids[1] != NO_ID:
        return _removed(docs, length, gram, with_text, crowd)
    # Ids that do not tell all rows apart: the numbers of (id, text) in their order stand for them.
    twin = F.xxhash64(F.coalesce("text", F.lit(b"")))
    named = stored(docs.withColumn("twin", twin).select("doc_id", "twin").distinct().repartitionByRange("doc_id", "twin").sortWithinPartitions("doc_id", "twin"), "ids")
    named = stored(numbered(named), "numbers").select(F.col("doc_id").alias("named"), F.col("twin").alias("named_twin"), "position")
    numbers = docs.withColumn("twin", twin).join(named, F.col("doc_id").eqNullSafe(F.col("named")) & (F.col("twin") == F.col("named_twin")))
    done = _removed(numbers.select(F.col("position").alias("doc_id"), "text"), length, gram, with_text, crowd)
    back = named.select("position", F.col("named").alias("id"))
    return done.join(back, F.col("doc_id") == F.col("position")).select(F.col("id").alias("doc_id"), *done.columns[1:])


def _removed(docs: DataFrame, length: int, gram: int, with_text: bool, crowd: int) -> DataFrame:
    """``dedup`` of documents with different ids, at most one of them null."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * tasks, -(-size // PART_BYTES))
    found = docs.mapInArrow(_found(parts, length, gram), _FOUND_SQL)
    found = stored(found, "anchors")
    solved = found.where("part is not null").repartition(parts, "part").mapInArrow(_resolved(crowd), _FOUND_SQL)
    places = found.where("part is null").unionByName(solved).groupBy("doc_id").agg(
        *[F.collect_set(F.when(F.col("kind") == k, F.col("at"))).alias(n) for n, k in (("full", FULL), ("edge", EDGE), ("single", SINGLE))]
    )
    places = stored(places.withColumnRenamed("doc_id", "own"), "places")
    dropped(found)
    joined = docs.join(places, F.coalesce(docs.doc_id, F.lit(NO_ID)) == places.own, "left").drop("own")
    spread = stored(joined.mapInArrow(_spread(parts, length, gram, with_text), _SPREAD), "spread")
    covered = spread.where(F.col("kind") == SENT).select("part", "text", "spans").groupBy("part").applyInArrow(_compared(length), "doc_id bigint, a bigint, b bigint")
    local = spread.where(F.col("kind") == SINGLE).select("doc_id", F.col("n_bytes").alias("a"), F.col("n_removed").alias("b"))
    more = covered.unionByName(local).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("more")).withColumnRenamed("doc_id", "own")
    waiting = spread.where(F.col("kind") == EDGE).select("doc_id", "text", "spans")
    waiting = waiting.join(more, F.coalesce(waiting.doc_id, F.lit(NO_ID)) == more.own, "left").drop("own")
    names = [x.split()[0] for x in _DONE.split(", ")]
    done = spread.where(F.col("kind") == FULL).select(*names).unionByName(waiting.mapInArrow(_finished(with_text), _DONE))
    return done if with_text else done.drop("kept")
