"""A Spark-native engine for reading, analysing and rendering document corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.document import to_json, to_markdown
from pagewright.operators.assembly import document_from, documents
from pagewright.sources.files import extension, read_files, sniff

__all__ = ["documents", "extension", "extract_tables", "extract_text", "parse", "parse_bytes", "read_files", "sniff", "to_dict", "to_json", "to_markdown"]
__version__ = "0.2.0"


def parse(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, doc, error) of the files of a path, by extension, else by their bytes."""
    found = read_files(spark, path, glob).withColumn("doc_id", F.xxhash64("path"))
    from pagewright.sources.files import FORMATS

    kind = F.when(F.col("format").isin(FORMATS), F.col("format")).otherwise(sniff(F.col("content")))
    made = documents(found.withColumn("format", kind), F.col("path"))
    path_of = made["doc"]["filename"]
    named = made["doc"].withField("filename", F.regexp_extract(path_of, r"([^/]*)$", 1))
    return made.select(path_of.alias("path"), named.alias("doc"), "error")


def parse_bytes(content: bytes, filename: str = "") -> dict:
    """The document of one file's bytes, by the name's extension, else by the bytes themselves."""
    from pagewright.sources.files import FORMATS, container_format

    ending = filename.rsplit(".", 1)[-1].lower() if "." in filename else ""
    ending = {"markdown": "md"}.get(ending, ending)
    if ending and ending not in FORMATS:
        raise ValueError(f"no format is known for {filename}")
    return document_from(content, ending or ("pdf" if content.startswith(b"%PDF-") else container_format(content)))[0] | {"filename": filename}


def extract_text(doc: Column) -> Column:
    """The text of a document."""
    return doc["text"]


def extract_tables(doc: Column) -> Column:
    """The tables of a document."""
    return doc["tables"]


def to_dict(row) -> dict:
    """A collected document as a dict."""
    return row.asDict(recursive=True)
