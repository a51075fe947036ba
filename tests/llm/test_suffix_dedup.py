import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from pagewright.llm import suffix_dedup as sd


def brute(rows, length):
    """(doc_id, text) to doc_id: (bytes, removed, spans, digest); ids are distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sd.dedup(docs, with_text=False, **kw).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}


def made(rng, n):
    pieces = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces) if rng.random() < 0.7 else rng.choice("xyz") for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "q" * 300), (1003, "ab" * 200), (None, rows[5][1]), (1004, rows[5][1])]


def test_against_brute_force(spark):
    rows = made(random.Random(1), 80)
    assert found(spark, rows, length=20, gram=6) == brute(rows, 20)


def test_crowded_anchors_lose_nothing(spark):
    rows = made(random.Random(2), 80)
    assert found(spark, rows, length=20, gram=6, crowd=1) == brute(rows, 20)


def test_documents(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(table["doc_id"], table["text"]))
    assert found(spark, rows) == brute(rows, 100)


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a" * 150), (1, "a" * 150)], "doc_id bigint, text string")
    assert [(r.n_removed, bytes(r.kept)) for r in sd.dedup(docs).collect()] == [(149, b"a")] * 2
    assert sd.dedup(docs.limit(0)).count() == 0


def test_deep_shallow_sorting():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(400)) * 2
    starts = np.arange(len(text) - 40)
    group = sd.deep_shallow(text, starts, 40)
    for i in range(0, len(starts), 7):
        for j in range(i, len(starts), 11):
            assert (group[i] == group[j]) == (text[i : i + 40] == text[j : j + 40])


def test_places_are_the_suffix_order():
    rng = random.Random(4)
    text = b"".join(rng.choice([b"abracadabra", b"\x00\xff", b"aaaaaaaaaaaaaaaa", b"z"]) for _ in range(150)) * 2
    starts = np.array(rng.sample(range(len(text) - 40), 600))
    for length, shallow in ((40, 24), (40, 8), (33, 40), (8, 24)):
        place = sd.deep_shallow(text, starts, length, shallow)
        strings = [text[i : i + length] for i in starts]
        assert [strings[i] for i in np.argsort(place, kind="stable")] == sorted(strings)
        assert place.tolist() == [sorted(strings).index(x) for x in strings]


def test_rows_that_share_an_id(spark):
    a, b, c = "".join(map(str, range(100))), "x" * 40 + "y" * 160, "unlike " * 30
    docs = spark.createDataFrame([(1, a), (2, a), (2, c), (2, b), (None, b), (None, "n"), (2, c)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, bytes(r.kept).decode()) for r in sd.dedup(docs).collect()}
    assert got[1, len(a)] == (0, a) and got[2, len(a)] == (len(a), "")
    assert got[None, 1] == (0, "n") and got[2, len(b)] == (len(b), "")
    alone = sd.dedup(spark.createDataFrame([(2, c)], "doc_id bigint, text string")).first()
    assert got[2, len(c)] == (alone.n_removed, bytes(alone.kept).decode()) and len(got) == 6
