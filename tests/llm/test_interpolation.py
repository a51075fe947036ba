import math
import random
from collections import Counter

import pytest

from pagewright.llm import interpolation as di


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</s>"]


def counted(rows, folds, order):
    """Counts of n-grams as (context, token), and of contexts."""
    grams, contexts = Counter(), Counter()
    for _, t, f in rows:
        if f in folds:
            seq = [f"<s{k}>" for k in range(order - 1, 0, -1)] + tokens(t)
            for i in range(order - 1, len(seq)):
                for k in range(order):
                    grams[tuple(seq[i - k : i]), seq[i]] += 1
                    contexts[tuple(seq[i - k : i])] += 1
    return grams, contexts


def estimates(grams, contexts, seq, i, order):
    """(bucket, estimates from the longest n-gram to the shortest) of a token."""
    p, bucket = [], 0
    for k in range(order - 1, -1, -1):
        c = contexts[tuple(seq[i - k : i])]
        p.append(grams[tuple(seq[i - k : i]), seq[i]] / c if c else 0.0)
        if k and c and not bucket:
            bucket = (k, int(math.log2(c + 1)))
    return bucket, p


def brute(rows, order):
    """(doc_id, text, fold) to the figures, by loops: exact estimates, and expectation-maximisation without bins."""
    grams, contexts = counted(rows, {0}, order)
    vocabulary = len({w for (c, w) in grams if c == ()})
    events = {}
    for _, t, f in rows:
        if f == 1:
            seq = [f"<s{k}>" for k in range(order - 1, 0, -1)] + tokens(t)
            for i in range(order - 1, len(seq)):
                bucket, p = estimates(grams, contexts, seq, i, order)
                events.setdefault(bucket, []).append([*p, 1 / (vocabulary + 1)])
    weights = {}
    for bucket, rows_ in events.items():
        mixed = [0.5, 0.3, 0.2] if order == 2 else [1 / (order + 1)] * (order + 1)
        for _ in range(60):
            sums = [0.0] * (order + 1)
            for p in rows_:
                whole = sum(m * x for m, x in zip(mixed, p))
                sums = [s + m * x / whole for s, m, x in zip(sums, mixed, p)]
            mixed = [max(s / len(rows_), 1e-9) for s in sums]
            mixed = [m / sum(mixed) for m in mixed]
        weights[bucket] = mixed
    start = [0.5, 0.3, 0.2] if order == 2 else [1 / (order + 1)] * (order + 1)
    grams, contexts = counted(rows, {0, 1}, order)
    n, words = contexts[()], Counter({w: c for (h, w), c in grams.items() if h == ()})
    out = []
    for i, t, _ in rows:
        own = tokens(t)
        seq = [f"<s{k}>" for k in range(order - 1, 0, -1)] + own
        base, full = sum(math.log10((words[w] + 1) / (n + len(words) + 1)) for w in own), 0.0
        for j in range(order - 1, len(seq)):
            bucket, p = estimates(grams, contexts, seq, j, order)
            mixed = weights.get(bucket, start)
            full += math.log10(sum(m * x for m, x in zip(mixed, [*p, 1 / (len(words) + 1)]))) if n else 0
        out.append((i, len(own), sum(words[w] > 0 for w in own), n, base, full))
    return out


def check(spark, rows, order=2, close=0.02):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fold int").repartition(3)
    got = sorted((tuple(r) for r in di.score(docs, order=order).collect()), key=lambda r: (repr(r[:4]), round(r[4], 6)))
    want = sorted(brute(rows, order), key=lambda r: (repr(r[:4]), round(r[4], 6)))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4]
        # the weights come from binned estimates, so scores agree but for a share
        assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=close, abs_tol=0.05)


@pytest.mark.parametrize("order, close", [(1, 0.002), (2, 0.005), (3, 0.03)])
def test_against_brute_force(spark, monkeypatch, order, close):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "sat", "é", "on\tmat", "dog."]) for _ in range(rng.randint(0, 30))), rng.randrange(3)) for i in range(150)]
    rows += [(500, None, 0), (501, "", 1), (None, "the cat", 2), (502, "the " * 3000, 0), (502, "the " * 3000, 0)]
    monkeypatch.setattr(di, "BLOCK_TOKENS", 500)
    check(spark, rows, order, close)


def test_without_training_or_rows(spark):
    check(spark, [(1, "a b", 2), (2, None, 2)])
    assert di.score(spark.createDataFrame([], "doc_id bigint, text string, fold int")).count() == 0


def test_longer_grams_know_repeated_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    twice = " ".join(rng.choice(words) for _ in range(80))
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), i % 5 == 0) for i in range(200)] + [(900, twice, 0), (901, twice, 1), (902, twice, 0), (903, twice, 1)]
    rows = [(i, t, int(f)) for i, t, f in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fold int")
    gain = {}
    for order in (2, 4):
        found = {r.doc_id: r.score for r in di.score(docs, order=order).collect()}
        gain[order] = found[900] - sum(found[i] for i in range(200)) / 200
    assert gain[4] > gain[2]


def test_the_mixture_beats_its_parts():
    log = lambda p, c: c * math.log2(p) if p else 0.0
    events = [(3, int(p > 0), int(q > 0), c, log(p, c), log(q, c)) for p, q, c in ((0.5, 0.01, 60), (0.0, 0.02, 30), (0.0, 0.0, 10))]
    events = [(k, a - 1 if not a else a, b - 1 if not b else b, *rest) for k, a, b, *rest in events]
    weights = di.maximise(events, 0.001)[3]
    assert abs(sum(weights) - 1) < 1e-9 and weights[0] > 0.4 and min(weights) > 0.01
