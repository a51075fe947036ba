"""Command line (E6, E7): documents of a path as text, Markdown or JSON, or what is known of them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import document
from pagewright.operators import assembly
from pagewright.sources import files


def documents(found: DataFrame) -> DataFrame:
    """(path, doc) of files with a path, content and format; those of other formats, or that cannot be read, are left out."""
    own = found.where(F.col("format").isin(files.FORMATS)).withColumn("doc_id", F.xxhash64("path"))
    made = assembly.documents(own, F.col("path")).where("doc is not null")
    path = F.col("doc")["filename"]
    return made.select(path.alias("path"), F.col("doc").withField("filename", F.regexp_extract(path, r"([^/]*)$", 1)).alias("doc"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("pagewright")
    parser.add_argument("path")
    parser.add_argument("--output", "-o", help="a folder for one text file a partition; else the rows are printed")
    shape = parser.add_mutually_exclusive_group()
    for names in (("--markdown", "--md"), ("--json", "-j"), ("--info", "-i")):
        shape.add_argument(*names, action="store_true")
    parser.add_argument("--include-images", action="store_true")
    parser.add_argument("--tables", action="store_true", help="the tables alone")
    parser.add_argument("--page", "-p", type=int, help="one page's text, from 0; documents without pages show all")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = documents(files.read_files(spark, args.path))
    doc = F.col("doc")
    if args.info:
        shown = F.to_json(F.struct(doc["filename"], doc["format"], doc["page_count"], doc["title"], doc["author"], F.size(doc["tables"]), F.size(doc["images"])))
    elif args.tables:
        shown = F.array_join(F.transform(doc["tables"], lambda t: t["markdown"]), "\n\n")
    elif args.page is not None:
        shown = F.coalesce(F.get(doc["pages"], F.lit(args.page))["text"], F.when(F.size(doc["pages"]) == 0, doc["text"]), F.lit(""))
    elif args.markdown:
        shown = document.to_markdown(doc, args.include_images)
    else:
        shown = document.to_json(doc, args.include_images, pretty=True) if args.json else doc["text"]
    rows = docs.select(shown.alias("value"))
    if args.output:
        rows.write.text(args.output)
        return 0
    empty = True
    for row in rows.toLocalIterator():
        print(row.value)
        empty = False
    return int(empty)


if __name__ == "__main__":
    sys.exit(main())
