import random

from pagewright.llm import line_dedup


def near(a, b):
    """Within one edit?"""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, min_words=3):
    lines = sorted((i, n, x) for i, t in rows.items() for n, x in enumerate((t or "").split("\n")))
    long = [(i, n, x) for i, n, x in lines if len(x.split()) >= min_words]
    gone = {(i, n) for k, (i, n, x) in enumerate(long) if any(near(x, y) for _, _, y in long[:k])}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows.items()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["aa", "bé", "cc", "ddd"]) for _ in range(rng.choice([2, 3, 5, 40]))) for _ in range(12)]
    base += [" ".join(f"w{rng.randint(0, 9)}" for _ in range(k)) for k in (16, 22, 43, 64, 65)]

    def line():
        x = rng.choice(base)
        if rng.random() < 0.7:
            p = rng.randrange(len(x) + 1)
            x = rng.choice([x[:p] + x[p + 1 :], x[:p] + "q" + x[p:], x[:p] + "é" + x[p + 1 :]])
        return x

    rows = {i: "\n".join(line() for _ in range(rng.randint(0, 6))) for i in range(60)}
    rows |= {100: None, 101: "", 102: "\n", 103: "x" * 63 + " a b", 104: "x" * 63 + " a bb", 105: "x" * 64 + " a b"}
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows.items()], "doc_id bigint, text string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs, min_words=3, near_chars=1).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    for i, r in got.items():
        before, after = (rows[i] or "").split("\n"), (want[i] or "").split("\n")
        assert r.n_lines == (0 if rows[i] is None else len(before))
        had, has = (sum(len(x.split()) > 2 for x in y) for y in (before, after))
        assert r.emptied == (had > 0 and has == 0)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "one two three"), (1, "one two three"), (2, "four five six\nshort"), (2, "four five six\nshort"), (3, "four five sixx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text, r.emptied) for r in line_dedup.dedup(docs).collect())
    two = ("2", "four five six\nshort", False)
    assert got == [("1", "", True), two, two, ("3", "four five sixx", False), ("None", "one two three", False)]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup(docs, near_chars=1).collect())
    assert got == [("1", ""), two[:2], two[:2], ("3", ""), ("None", "one two three")]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(5, "aaa bbb ccc\nx", 1), (5, "ddd eee fff\ny", 2), (5, None, 3), (5, "", 4), (6, "x\ny\nz", 5), (None, "z", 6), (None, "z\nw", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept int").withColumnRenamed("kept", "kept")
    got = {r.kept: r for r in line_dedup.dedup(docs.withColumn("twin", docs.kept).withColumn("pos", docs.kept)).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 5)] == ["aaa bbb ccc\nx", "ddd eee fff\ny", None, "", ""]
    assert sorted((got[6].text, got[7].text)) in ([ "", "z\nw"], ["w", "z"])
    assert all(r.n_removed >= 0 for r in got.values()) and all(r.twin == r.pos == i for i, r in got.items())
