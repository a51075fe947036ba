import random

from pyspark.sql import functions as F

from pagewright.functions import render, textops
from pagewright.operators import layout
from pagewright.plans import catalog
from pagewright.sources import files, ooxml


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_a1(spark):
    df = spark.range(1, 18279).select("id", textops.letters_to_column(textops.column_to_letters(F.col("id"))).alias("back"))
    assert df.where("id <> back").count() == 0
    assert [one(spark, textops.column_to_letters(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_text(spark):
    assert one(spark, textops.plain_text(F.lit("# T\n\n\n\n**b** [x](y) ![i](j)"))) == "T\n\nb x"
    assert one(spark, textops.image_kind(F.unhex(F.lit("89504E470D0A")))) == "png"
    assert one(spark, textops.media_type(F.lit("word/media/a.JPG"))) == "image/jpeg"
    assert one(spark, textops.text_width(F.lit("a가"), F.lit(10.0))) == 13.5
    assert one(spark, textops.doc_clean(F.lit("a\x07b\x0bc\x01d"))) == "a\tb\ncd"


def test_grids(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 2, "b"), (1, 1, 2, "c")], "k int, row int, col int, text string")
    got = render.dense(cells, ["k"]).select("*", render.tsv(F.col("grid")).alias("t")).first()
    assert (got.rows, got.cols, got.t) == (2, 3, "a\t\t\n\t\tb c")
    ragged = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    assert one(spark, render.markdown(render.widened(ragged))) == "| a | b |\n| --- | --- |\n| c |  |"


def test_broken_files(spark):
    made = spark.createDataFrame([(1, bytearray(b"PK\x03\x04 broken")), (2, None)], "doc_id bigint, content binary")
    assert [r.kind for r in ooxml.elements(made, "xlsx").collect()] == ["error", "error"]
    assert {r.f for r in made.select(files.sniff(F.col("content")).alias("f")).collect()} == {"txt"}


def test_sections_in_numeric_order(spark):
    made = spark.createDataFrame([(1, bytearray(ooxml.write_hwpx([f"p{i}" for i in range(12)])))], "doc_id bigint, content binary")
    assert [r.text for r in ooxml.elements(made, "hwpx").orderBy("row").collect()] == [f"p{i}" for i in range(12)]


def test_anchor_fold(spark):
    rng = random.Random(1)
    rows = [(1, p, i, float(rng.randint(0, 99)), float(rng.randint(0, 60)), f"t{i}") for p in range(5) for i in range(30)]
    items = spark.createDataFrame(rows, "doc_id int, page int, seq int, x double, y double, text string")
    want = {}
    for p in range(5):
        ys, anchor, number = sorted({r[4] for r in rows if r[1] == p}), None, -1
        of = {}
        for y in ys:
            if anchor is None or y - anchor > 5:
                anchor, number = y, number + 1
            of[y] = number
        for n in set(of.values()):
            own = sorted((r[3], r[2], r[5]) for r in rows if r[1] == p and of[r[4]] == n)
            want[p, n] = " ".join(t for _, _, t in own)
    assert {(r.page, r.line): r.text for r in layout.lines(items).collect()} == want


def test_every_query_runs(spark):
    for name, query in catalog.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
