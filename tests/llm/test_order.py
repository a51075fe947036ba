from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import mixing


def test_numbers_follow_names_and_not_sizes(spark, tmp_path):
    # the first file of the order is the smallest: a reader that packs by size has it last
    rows = spark.range(3000).select(F.col("id").alias("position"), F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") / 100).cast("int")).alias("text"))
    ids = rows.select(F.col("position").alias("doc_id"), "text", "position")
    ids.repartitionByRange(8, "position").sortWithinPartitions("position").drop("position").write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = mixing.numbered(spark.read.parquet(str(tmp_path / "mixed"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.position, r.doc_id) for r in got) == [(i, i) for i in range(3000)]


def test_interleaving_holds_in_runs_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    kept, mixture = [], corpus_pipeline.mixture

    def some(spark, docs, sf_dir):
        kept.append(mixing.mix(docs).select("doc_id", "source", "position").collect())
        return mixture(spark, docs, sf_dir)

    stages = [("mixture", some), corpus_pipeline.STAGES[-1]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.position)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(kept[0], key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(want)))
    assert [(r.doc_id, r.source) for r in got] == [(r.doc_id, r.source) for r in want]
    assert all(r.round_trip for r in got)
