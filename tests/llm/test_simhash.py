import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from pagewright.llm import simhash


def brute_print(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, tau=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= tau:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_against_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "a b c", "A b C d E f", "é x y z w\x0bq", "x " * 5000]
    texts += [" ".join(rng.choice(["aa", "B", "ß", "c."]) for _ in range(rng.randint(0, 40))) for _ in range(50)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def clustered(seed, n):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    out = []
    for _ in range(n):
        x = rng.choice(seeds) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


def roots_of(spark, prints, **kw):
    rows = [(i, simhash._signed(x)) for i, x in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node bigint, fp bigint")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, **kw)).collect()}
    return {i: found.get(i, i) for i in range(len(prints))}


def test_no_link_is_lost(spark):
    prints = clustered(5, 600)
    assert roots_of(spark, prints) == brute_roots(dict(enumerate(prints)))


def test_hot_keys_are_cut_without_loss(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for _ in range(500)})
    assert roots_of(spark, prints, most=32) == brute_roots(dict(enumerate(prints)))


def test_long_chains(spark):
    prints, x = [], 0
    for i in range(60):
        prints.append(x)
        x ^= 0xF << (4 * (i % 15)) if i % 2 else 1 << (i % 64)
    prints = list(dict.fromkeys(prints))
    assert roots_of(spark, prints) == brute_roots(dict(enumerate(prints)))


def test_documents(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(7, text, "a"), (3, text.upper(), "b"), (9, None, "c"), (8, "", "c"), (None, text, "d"), (5, "other words entirely here", "e"), (5, "other words entirely here", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter([(7, 3), (3, 3), (9, 8), (8, 8), (None, 3), (5, 5), (5, 5)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    shown = simhash.near_duplicates(docs).select(simhash.hexed().alias("h")).where(F.length("h") != 16)
    assert shown.count() == 0


def test_longer_masks_lose_no_pair():
    rng = random.Random(9)
    for _ in range(300):
        mask = rng.getrandbits(64)
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample([k for k in range(64) if not mask >> k & 1], rng.randint(0, 4)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in simhash.longer_masks(mask, 4))
    assert simhash.longer_masks((1 << 64) - 4, 4) == []
