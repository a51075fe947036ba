import random

import duckdb

import __spark_entry__
import corpus_pipeline
from pagewright.llm import line_dedup
from test_line_dedup import near


def brute(rows, chars=line_dedup.NEAR_CHARS):
    seen, out = [], {}
    for i, text in sorted(rows.items()):
        kept = []
        for line in text.split("\n"):
            long = len(line) >= chars
            if not line.split() or not any(line == x or long and also and near(line, x) for x, also in seen):
                kept.append(line)
            if line.split():
                seen.append((line, long))
        out[i] = "\n".join(kept)
    return out


def test_short_lines_against_brute_force(spark):
    rng = random.Random(8)
    base = ["Home", "Read more", "a b c", "中文" * 3, "中文字符没有空格的一行文字很长很长的", "日本語の文にはくうはくがない", "x" * 15, "y" * 16, " ", ""]

    def line():
        x = rng.choice(base)
        p = rng.randrange(len(x) + 1)
        return rng.choice([x, x, x[:p] + "q" + x[p:], x[:p] + x[p + 1 :]])

    rows = {i: "\n".join(line() for _ in range(rng.randint(1, 5))) for i in range(60)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert found == brute(rows)


def test_stage_drops_repeats_of_short_lines(spark):
    rows = [(1, "Home\nfirst text of some words"), (2, "Home\n\nother text of more words"), (3, "Home"), (4, "中文字符没有空格的一行文字很长很长"), (5, "x y\n中文字符没有空格的一行文字很长很短")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert left == {1: rows[0][1], 2: "\nother text of more words", 4: rows[3][1], 5: "x y"}


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = __spark_entry__.queries()["op6_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    with duckdb.connect() as db:
        db.execute(f"create view documents as from '{sf}/documents.parquet'")
        want = db.execute(__spark_entry__.oracle_sql()["op6_line_dedup"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
