import random

import numpy as np

import corpus_pipeline
from pagewright.llm import simhash


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, similarity=0.8):
    sets, root = {i: shingles(t) for i, t in rows}, {}
    for i in sorted(sets):
        root[i] = i
        for j in sorted(root):
            union = sets[i] | sets[j]
            if j != i and (not union or len(sets[i] & sets[j]) >= similarity * len(union)):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def corpus(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 60, 150, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, " "), (n + 2, "one two"), (n + 3, "ONE  two")]


def test_links_are_exact(spark):
    rows = corpus(2, 150)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs, tau=simhash.SIMILAR_TAU, shingle=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows)


def test_groups_skip_no_link():
    rng = np.random.default_rng(1)
    pool = np.arange(60, dtype=np.uint64)
    sets = [np.sort(rng.permutation(pool)[: rng.integers(40, 60)]) for _ in range(80)]
    want = brute([])
    label = list(range(80))
    for i in range(80):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                label = [label[j] if x == label[i] else x for x in label]
    got = list(range(80))
    for i, j in simhash._similar(np.zeros(80, np.uint64), sets, 24, 0.8):
        got = [got[j] if x == got[i] else x for x in got]
    assert want == {} and len({*zip(label, got)}) == len({*label}) == len({*got})


def test_stage_drops_copies_of_similarity_over_four_fifths(spark):
    rng = random.Random(6)
    rows, source = [], []
    for k in range(20):
        words = [f"w{rng.randrange(9000)}" for _ in range(300)]
        other = list(words)
        for at in (30, 90, 150, 210, 270):
            other[at] = f"changed{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {2 * k for k in range(20)}


def test_null_ids_repeats_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(7, text), (3, text.upper()), (None, text), (5, "other words"), (5, "other words"), (None, "alone")], "doc_id bigint, text string")
    found = simhash.near_duplicates(docs, tau=24, shingle=5, similarity=0.8)
    assert sorted((str(r.doc_id), r.component_id) for r in found.collect() if r.component_id) == [("3", 3), ("5", 5), ("5", 5), ("7", 3), ("None", 3)]
    assert found.where("component_id is null").count() == 1
    assert simhash.near_duplicates(docs.limit(0), tau=24, shingle=5, similarity=0.8).count() == 0


def test_similar_sets_share_a_segment_of_their_wide_prints():
    rng = np.random.default_rng(4)
    sets = []
    for k in range(1200):
        pool = rng.integers(0, 1 << 64, [5, 20, 90, 900][k % 4], dtype=np.uint64)
        cut = len(pool) // 10
        sets += [pool[cut:], pool[: len(pool) - max(cut, 1)]]  # at a similarity of 0.8 or a little more
    prints = simhash.wide_prints(sets)
    bits, keys, most = simhash.segments(200_000, 0.8)
    found, chains = simhash.ring_keys(prints, bits, keys)
    assert ((found[::2] == found[1::2]).any(1)).mean() > 0.998
    pairs = np.repeat(np.arange(len(sets) // 2), 2)
    linked = [simhash._near(np.ascontiguousarray(chains[:, k]), pairs, most)[1::2] == np.arange(0, len(sets), 2) for k in range(keys)]
    assert (np.stack(linked, 1) & (found[::2] == found[1::2])).any(1).mean() > 0.998
    strangers = simhash._near(np.ascontiguousarray(chains[:, 0]), np.roll(pairs, 1), most)
    assert (strangers == np.arange(len(sets))).mean() > 0.99
    assert 0.14 < np.unpackbits(prints[2::8] ^ prints[3::8], axis=1).mean() < 0.16


def test_candidates_come_from_the_simhash_alone(spark, monkeypatch):
    rows = corpus(7, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    apart = np.random.default_rng(1)
    monkeypatch.setattr(simhash, "ring_keys", lambda prints, bits, keys: (apart.integers(1 << 62, size=(len(prints), keys)), np.zeros((len(prints), keys, 2), np.uint64)))
    found = simhash.near_duplicates(docs, tau=simhash.SIMILAR_TAU, shingle=5, similarity=0.8).collect()
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    assert {r.doc_id: r.component_id for r in found} == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
