"""Deleted interpolation: n-gram estimates of orders 1 to ``order``, mixed by context-frequency buckets.

P(w | h) is the sum over k of l_k * c(h_k w) / c(h_k), where h_k are the last k - 1 tokens, and l_0 / (V + 1).  The
weights l depend on the longest context that has been seen and the power of two of its count.  Part of the training
texts is deleted from the counts; expectation-maximisation on those texts learns the weights; the final counts hold all
training texts.

Counting is exact and hash-partitioned.  Texts are cut into blocks, which are stored once; each block sends every
distinct n-gram once, with its count, as sorted 64-bit hashes in compressed columns, so a hot word costs one entry a
block.  Each range of hashes is summed in one place, with as many ranges as the tokens ask for, and the totals go back
to the blocks, which then hold all they need to score.  What the driver sees is the size of the vocabulary and a
histogram of held-out events with a fixed number of bins.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bytewise as bw
from pagewright.llm.store import stored

TRAIN, DELETED, OTHER = 0, 1, 2
BLOCK_TOKENS = 400_000
#: Tokens for which a range of hashes is kept apart, so a range does not grow with the input.
PART_TOKENS = 4_000_000
END, BEGIN, PAIR = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x8F1BBCDCBFA53E0B), np.uint64(0xD1B54A32D192ED03)
BUCKETS = 40
#: Steps of a factor of two in the histogram of held-out probabilities (by order), and its least exponent.
STEPS, LEAST = {1: 16, 2: 4}, -48
MORE_STEPS = 1
_BLOCK_SQL = "block string, tokens bigint, ids binary, shape binary, words binary, back binary"
_PART_SQL = "block string, kind int, part int, ids binary, a binary, b binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _edges(parts: int) -> np.ndarray:
    return np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)


def _tokens(hashes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Tokens: words, then an end for each text."""
    tokens = np.full(len(hashes) + len(n_words), END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[np.cumsum(n_words + 1) - 1] = False
    tokens[is_word] = hashes
    return tokens


def _grams(tokens: np.ndarray, n_words: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of orders 1 to ``order`` that end at each token; before a text's first token stands a beginning."""
    first = np.cumsum(n_words + 1) - n_words - 1
    grams = [tokens]
    for k in range(1, order):
        context = np.roll(grams[-1], 1)
        context[first] = BEGIN + np.uint64(k)
        grams.append(bw.mix(context * PAIR + tokens))
    return grams


def _block(held: list[tuple]) -> pa.RecordBatch:
    """A block as it is stored: its ids, words a text, folds, distinct words and the word of each token."""
    ids, folds, hashes, n = zip(*held, strict=True)
    ids, folds, n_words = [x for i in ids for x in i], np.concatenate(folds), np.concatenate(n)
    words, back = np.unique(_tokens(np.concatenate(hashes), n_words), return_inverse=True)
    lost = np.array([i is None for i in ids])
    known = bw.pack(np.array([0 if i is None else i for i in ids], np.int64))
    shape = b"".join(len(x).to_bytes(4, "little") + x for x in (bw.pack(n_words.astype(np.int64)), bw.pack(folds.astype(np.int8)), bw.pack(lost.astype(np.int8))))
    return _batch([(uuid.uuid4().hex, len(back), known, shape, bw.pack(words, delta=True), bw.pack(back.astype(np.uint32)))], _BLOCK_SQL)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        ids, folds = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        for begin, end, data, offsets in bw.blocks(batch.column(1)):
            if end - begin == 1 and len(data) > 2 * bw.BLOCK_BYTES:
                hashes = np.concatenate([bw.words(x, np.array([0, len(x)]), lower=True).hashes() for x in bw.pieces(data)])
                n = np.array([len(hashes)])
            else:
                w = bw.words(data, offsets, lower=True)
                hashes, n = w.hashes(), np.diff(w.first)
            held.append((ids[begin:end], folds[begin:end], hashes, n))
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, words a text, folds, ids lost) of a stored block."""
    n_words, folds, lost = _shape(row["shape"])
    return bw.unpack(row["words"], delta=True)[bw.unpack(row["back"])], n_words, folds, lost


def _sent(parts: int, kind: int):
    """Each block's distinct n-grams of order ``kind`` + 1 with their counts in both training folds, by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(parts)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens, n_words, folds, _ = _opened(row)
                fold = np.repeat(folds, n_words + 1)
                values, back = np.unique(_grams(tokens, n_words, kind + 1)[kind], return_inverse=True)
                counts = [np.bincount(back[fold == f], minlength=len(values)).astype(np.uint32) for f in (TRAIN, DELETED)]
                cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
                rows = [(row["block"], kind, part, bw.pack(values[a:b], delta=True), bw.pack(counts[0][a:b]), bw.pack(counts[1][a:b])) for part, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield _batch(rows, _PART_SQL)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums equal hashes over all blocks of this partition and answers each row; adds a row of statistics."""
    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(r["kind"], []).append((r["block"], r["part"], r["ids"], r["a"], r["b"]))
    for kind in sorted(held):
        own = held.pop(kind)
        hashes = [bw.unpack(r[2], delta=True) for r in own]
        cuts = np.cumsum([0, *map(len, hashes)])
        values, back = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        sums = []
        for k in (3, 4):
            counts = np.concatenate([bw.unpack(r[k]) for r in own])
            sums.append(np.bincount(back, weights=counts, minlength=len(values)).astype(np.uint64))
        for i, r in enumerate(own):
            at = back[cuts[i] : cuts[i + 1]]
            yield _batch([(r[0], kind, r[1], None, bw.pack(_narrow(sums[0][at])), bw.pack(_narrow(sums[1][at])))], _PART_SQL)
        if kind == 0:
            train, deleted = sums
            figures = [train.sum(), deleted.sum(), (train > 0).sum(), (train + deleted > 0).sum()]
            yield _batch([("", 99, -1, np.array(figures, np.int64).tobytes(), None, None)], _PART_SQL)


@dataclass(frozen=True)
class Model:
    """Sizes of the training texts and the weights (from the longest n-gram to the uniform share) of each context bucket."""

    train_tokens: int
    vocabulary: int
    weights: tuple


def _bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """The bucket of each token by the counts of its contexts, the shortest first: the longest that has been seen counts."""
    power = lambda c: np.minimum(np.floor(np.log2(c.astype(np.float64) + 1)), BUCKETS - 1).astype(np.int64)
    bucket = power(contexts[0])
    for k, counts in enumerate(contexts[1:], 1):
        bucket = np.where(counts > 0, k * BUCKETS + power(counts), bucket)
    return bucket


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


def _shape(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        size = int.from_bytes(packed[at : at + 4], "little")
        out.append(bw.unpack(packed[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _restored(table: pa.Table, order: int):
    """From a block and its totals: ids, folds, words a text, ends, and for both folds the totals of each token's n-grams and of their contexts."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] < 0)
    tokens, n_words, folds, lost = _opened(own)
    ids = [None if x else int(i) for i, x in zip(bw.unpack(own["ids"]), lost, strict=True)]
    ends = np.cumsum(n_words + 1) - 1
    answers = sorted((r for r in rows if r["kind"] >= 0), key=lambda r: (r["kind"], r["part"]))
    grams: list[list] = [[], []]
    for kind, values in enumerate(_grams(tokens, n_words, order)):
        back = np.unique(values, return_inverse=True)[1]
        for totals, f in zip(grams, ("a", "b"), strict=True):
            totals.append(np.concatenate([np.zeros(0, np.int64), *[bw.unpack(r[f]).astype(np.int64) for r in answers if r["kind"] == kind]])[back])
    contexts = []
    for totals in grams:
        own = []
        for k in range(1, order):  # an n-gram's context is the shorter one before; every training text has one beginning, as it has one end
            before = np.roll(totals[k - 1], 1)
            before[ends - n_words] = totals[0][ends]
            own.append(before)
        contexts.append(own)
    return ids, folds, n_words, ends, grams, contexts


def _shares(grams: list[np.ndarray], contexts: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates, the longest n-gram's first."""
    return [g / np.maximum(c, 1) for g, c in zip(grams[:0:-1], contexts[::-1], strict=True)] + [grams[0] / max(n, 1)]


def _steps(order: int) -> int:
    return STEPS.get(order, MORE_STEPS)


def _quantised(p: np.ndarray, steps: int) -> np.ndarray:
    """-1 for zero, else the step of the logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(np.rint((np.log2(p) - LEAST) * steps), 0), -1).astype(np.int32)


def _context_buckets(grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    return _bucket(contexts) if contexts else np.zeros(len(grams[0]), np.int64)


def _events(train_tokens: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        _, folds, n_words, _, grams, contexts = _restored(table, order)
        held = np.repeat(folds, n_words + 1) == DELETED
        own, before = [g[held] for g in grams[0]], [c[held] for c in contexts[0]]
        shares = _shares(own, before, train_tokens)
        keys = np.stack([_context_buckets(own, before), *[_quantised(p, _steps(order)) for p in shares]], 1)
        found, back, counts = np.unique(keys, axis=0, return_inverse=True, return_counts=True) if len(keys) else (np.zeros((0, order + 1), int), np.zeros(0, int), np.zeros(0, int))
        made = {"k": found[:, 0].astype(np.int32)} | {f"p{i}": found[:, i].astype(np.int32) for i in range(1, order + 1)} | {"n": counts.astype(np.int64)}
        for i, p in enumerate(shares, 1):
            made[f"s{i}"] = np.bincount(back.reshape(-1), weights=np.log2(np.where(p > 0, p, 1)), minlength=len(found)).astype(np.float64)
        return pa.table(made)

    return run


def maximise(events: list[tuple], uniform: float, order: int = 2, rounds: int = 60) -> tuple:
    """Weights of each bucket by expectation-maximisation over bins of held-out events.

    A bin has its bucket, a step for each estimate (-1 for zero), the count, and the sums of the estimates' logarithms,
    whose means stand for its events.
    """
    start = np.array([0.5, 0.3, 0.2]) if order == 2 else np.full(order + 1, 1 / (order + 1))
    weights = [start] * (BUCKETS * max(order - 1, 1))
    rows = np.array(events, np.float64).reshape(-1, 2 * order + 2)
    for k in np.unique(rows[:, 0]).astype(int):
        own = rows[rows[:, 0] == k]
        count = own[:, order + 1 : order + 2]
        estimates = np.where(own[:, 1 : order + 1] < 0, 0, 2.0 ** (own[:, order + 2 :] / count))
        p = np.concatenate([estimates, np.full((len(own), 1), uniform)], 1)
        mixed = start
        for _ in range(rounds):
            share = p * mixed
            mixed = (count * share / share.sum(1, keepdims=True)).sum(0)
            mixed = np.maximum(mixed / mixed.sum(), 1e-9)
            mixed = mixed / mixed.sum()
        weights[k] = mixed
    return tuple(map(tuple, weights))


def _scores(model: Model, order: int):
    def run(table: pa.Table) -> pa.Table:
        ids, _, n_words, ends, grams, contexts = _restored(table, order)
        whole, before = [a + b for a, b in zip(*grams, strict=True)], [a + b for a, b in zip(*contexts, strict=True)]
        n, v, word = model.train_tokens, model.vocabulary, whole[0]
        offsets = np.concatenate([[0], ends + 1])
        weights = np.array(model.weights)[_context_buckets(whole, before)].T
        mixed = sum(w * p for w, p in zip(weights, _shares(whole, before, n))) + weights[-1] / (v + 1) if n else np.ones(len(word))
        base = np.log10(word.astype(np.float64) + 1) - math.log10(n + v + 1)
        made = [np.add.reduceat(x, offsets[:-1]) for x in (np.log10(mixed), base)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": n_words + 1, "n_known": bw.per_doc(word > 0, offsets), "train_tokens": np.full(len(ids), n, np.int64), "base_score": made[1], "score": made[0]})

    return run


def score(df: DataFrame, fold: str = "fold", column: str = "text", order: int = 2) -> DataFrame:
    """Scores every text by a model of those in folds ``TRAIN`` and ``DELETED``; other folds are scored only.

    ``order`` is that of the longest n-gram.  Returns doc_id (integer), n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score, both log10.  Null counts as the empty text: one token, the end.  Repeated rows count
    and are returned as often as they stand; an empty table gives an empty one.  Without training texts every token has
    probability 1.
    """
    if order < 1:
        raise ValueError("the order is 1 or more")
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("bigint"), F.col(f"`{column}`"), F.col(fold).cast("int").alias("fold"))
    blocks = stored(docs.mapInArrow(_blocks, _BLOCK_SQL), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))
    # An order at a time, so that the parts of one alone are on disk.
    counted = [stored(blocks.mapInArrow(_sent(parts, k), _PART_SQL).repartition(parts, "part").mapInArrow(_totals, _PART_SQL), "totals") for k in range(order)]
    totals = reduce(DataFrame.unionAll, counted)
    figures = [np.frombuffer(r["ids"], np.int64) for r in totals.where("kind = 99").select("ids").collect()]
    trained, deleted, v_train, v = map(int, np.sum(figures, axis=0)) if figures else (0, 0, 0, 0)
    null = F.lit(None).cast("binary")
    own = blocks.select("block", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "ids", null.alias("a"), null.alias("b"), "shape", "words", "back")
    answers = totals.where("kind < 99").select("block", "kind", "part", "ids", "a", "b", *[null.alias(c) for c in ("shape", "words", "back")])
    # Joined twice, for the events and for the scores: that is cheaper than keeping the totals of every token on disk.
    joined = own.unionByName(answers).groupBy("block")
    names, sums = [f"p{i}" for i in range(1, order + 1)], [f"s{i}" for i in range(1, order + 1)]
    events = joined.applyInArrow(_events(trained, order), ", ".join(["k int", *[f"{p} int" for p in names], "n bigint", *[f"{x} double" for x in sums]]))
    events = stored(events.groupBy("k", *names).agg(*[F.sum(c).alias(c) for c in ("n", *sums)]), "events").collect()  # at most one row a bin
    model = Model(trained + deleted, v, maximise([tuple(r) for r in events], 1 / (v_train + 1), order))
    return joined.applyInArrow(_scores(model, order), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
