"""The corpus pipeline: from raw documents to packed token ids, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, line_dedup, mixing, quality_nn, simhash
from pagewright.llm.store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Learned and hash-based stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model = quality_nn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_nn.score(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeats of earlier lines, long lines within one edit of one, and documents with no line left that is not blank."""
    left = line_dedup.dedup(docs).where("not emptied").select(*COLUMNS)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate class; rows that repeat an id stay together.

    Near duplicates have a Jaccard similarity of their five-word shingles of 0.8 or more, or are chained by such.
    """
    classes = simhash.near_duplicates(docs, tau=simhash.SIMILAR_TAU, shingle=5, similarity=0.8)
    first = classes.where("component_id is null or doc_id = component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "first")
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: row after row and file after file by name."""
    return mixing.ordered(mixing.mix(docs)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, whether they decode to the text's bytes, and the position in the mixture.

    ``docs`` are the files of the mixture, as read.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = mixing.numbered(docs).select("doc_id", "source", "position", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "source", "n_tokens", "ids", same.alias("round_trip"), "position")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("source mixing", mixture),
    ("byte-level BPE", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written and read again as the input of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
