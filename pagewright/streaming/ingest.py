"""New files as they arrive: the file reader as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources import files

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """path, length, content and format by extension of every new file; other extensions go by magic bytes."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(path)
    named = files.extension(F.col("path"))
    return found.withColumn("format", F.when(named.isin(files.FORMATS), named).otherwise(files.sniff(F.col("content"))))
