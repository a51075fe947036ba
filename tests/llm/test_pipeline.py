import tiktoken
import public_tokenizers

import corpus_pipeline
from pagewright.llm import bpe, line_quality, quality_nn
from pagewright.llm.store import stored


def test_stages_keep_columns_and_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf), "test")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.count() <= before.count()
    left = {r.doc_id: r.text for r in docs.collect()}
    assert sum(labels.get(i) == 0 for i in left) <= 3
    assert sum(q == 1 and i in left for i, q in labels.items()) > 0.7 * sum(q == 1 for q in labels.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == set(left) and all(r.round_trip for r in last)


def test_codec_matches_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("", "Hello  world's\n\n\tend ", "é日本\x1c x" * 9000, "a" + " " * 3000 + "b", "\n" * 2500, "x" * 60_000 + " y"):
        ids = codec.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == whole.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert len(codec.encode("\n" * 3_000_000)) > 0


def test_encoding_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 6), (None, "", 7)], "doc_id bigint, text string, n_tokens int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in got.collect()) == [("1", 2, b"a b")] * 2 + [("2", 0, b""), ("None", 0, b"")]
    assert bpe.decode(got.drop("decoded"), path, public_tokenizers.PATTERN).where("decoded = encode(coalesce(text, ''), 'UTF-8')").count() == 4
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_line_quality_rows(spark):
    prose = "Some words of plain prose stand here and then some more follow them."
    junk = "\n".join(f"w{i}*** v{i}### u{i}$$$ t{i}%%% s{i}&&&" for i in range(9))
    docs = spark.createDataFrame([(1, prose, "x"), (2, junk, "x"), (3, None, "x"), (None, f"{prose}\n{junk[:40]}", "x")], "doc_id bigint, text string, kept string")
    got = {r.doc_id: r for r in line_quality.clean(docs).collect()}
    assert [got[i].kept for i in (1, 2, 3, None)] == [True, False, False, True]
    assert got[None].clean_text == prose and got[3].n_words == 0 and got[3].base_failed
    assert line_quality.clean(docs.limit(0)).count() == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_nn.fit(docs, labels.where(quality_nn.remainder(4) != 2))
    held = quality_nn.score(docs.join(labels, "doc_id").where(quality_nn.remainder(4) == 2), model).collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0)], "doc_id bigint, text string, score double")
    assert all(0 <= r.score <= 1 for r in quality_nn.score(odd, model).collect())
    assert quality_nn.fit(docs, labels.where("quality = 1")).constant == 1.0
    assert quality_nn.fit(docs, labels.limit(0)).constant == 0.5


def test_texts_that_pass_through_are_sent_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    scored = quality_nn.score(docs, quality_nn.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")))
    for found in (coded, scored):
        assert "__source__" not in found._jdf.queryExecution().analyzed().toString()
        assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "a b"), (2, None)]
