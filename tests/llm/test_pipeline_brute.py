import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
import test_short_lines
import test_similarity
from pagewright.llm import bpe, mixing, quality_nn

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(rng):
    """Documents with junk, repeated and near lines, copies, near copies, nulls and several sources, and labels of some."""
    words = [f"word{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(8) + "." for _ in range(5)]
    rows, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        if good:
            text = "\n".join([*(line(rng.randint(6, 20)) + "." for _ in range(rng.randint(2, 5))), *rng.sample(shared, rng.randint(0, 2))])
        else:
            text = " ".join(rng.choice(["$$$", "WIN!!!", "###", "click***", "9999"]) for _ in range(30))
        rows.append((i, text, "en", f"s{rng.randrange(3)}", len(text)))
        if i < 90:
            labels.append((i, int(good)))
    for i, j in ((200, 4), (201, 7), (202, 10)):
        text = rows[j][1].replace("word1 ", "word2 ", 1)
        rows.append((i, text, "en", "s1", len(text)))
    return [*rows, (300, None, None, None, None), (301, "", "en", None, 0)], labels


def brute(spark, rows, labels):
    """(doc_id, ids) in the order of the mixture, each stage by loops; the classifier's model is the stage's own."""
    docs, known = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality_nn.fit(docs, known)
    kept = []
    for r in rows:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        word, shape, first = quality_nn.slots(data, np.array([0, len(data)]))
        if model.scores(quality_nn.pooled(word, shape, first, model.vectors, model.shapes))[0] >= 0.7:
            kept.append(r)
    texts = test_short_lines.brute({r[0]: r[1] for r in kept if r[1] is not None})
    left = [(*r[:1], texts.get(r[0]), *r[2:]) for r in kept]
    has = lambda t: any(x.split() for x in (t or "").split("\n"))
    left = [r for r, old in zip(left, kept) if has(r[1]) or not has(old[1])]
    roots = test_similarity.brute([(r[0], r[1]) for r in left])
    left = [r for r in left if roots[r[0]] == r[0]]
    mixed = mixing.mix(spark.createDataFrame(left, COLUMNS)).collect()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r[0]: r[1] or "" for r in left}
    return [(r.doc_id, whole.encode_ordinary(texts[r.doc_id])) for r in sorted(mixed, key=lambda r: r.position)]


def test_run_against_loops(spark, tmp_path):
    rows, labels = made(random.Random(2))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    want = brute(spark, rows, labels)
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(want))) and all(r.round_trip for r in got)
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert 40 < len(want) < 85


def test_stages_on_nulls_and_empty_tables(spark):
    odd = [(None, None, None, None, None), (1, "", None, None, 0), (1, "x y z", "en", "a", 5), (1, "x y z", "en", "a", 5), (2, "x" * 100_000, "en", "a", 100_000)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, COLUMNS)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            found = stage(spark, docs, "")
            assert found.columns == corpus_pipeline.COLUMNS and found.count() <= len(rows), name
