"""Reading files of any supported format, and telling formats apart."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.sources import compound

FORMATS = ["pdf", "docx", "pptx", "xlsx", "hwpx", "doc", "ppt", "xls", "hwp", "txt", "md"]


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, content and the format by extension (E3, E4); the scan prunes ``content`` where it is not asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.withColumn("format", extension(F.col("path")))


def extension(path: Column) -> Column:
    """The lowered suffix, ``markdown`` as ``md``."""
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(found == "markdown", "md").otherwise(found)


#: By which members or streams a container's format is known, in this order.
ZIP_MEMBERS = {"word/": "docx", "ppt/": "pptx", "xl/": "xlsx", "Contents/": "hwpx"}
STREAMS = {"WordDocument": "doc", "PowerPoint Document": "ppt", "Workbook": "xls", "Book": "xls"}


def container_format(data: bytes) -> str:
    """The format of a ZIP or compound file by what is in it; ``txt`` where nothing is known."""
    try:
        if data[:8] == compound.MAGIC:
            found = compound.streams(data)
            kind = next((f for name, f in STREAMS.items() if name in found), None)
            return kind or ("hwp" if found.get("FileHeader", b"").startswith(b"HWP") else "txt")
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        return next((f for p, f in ZIP_MEMBERS.items() if any(p in n for n in names)), "txt")
    except Exception:  # whatever is broken in it, it is no container of a known format
        return "txt"


@F.pandas_udf(T.StringType())
def _container(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else container_format(bytes(c)))


def sniff(content: Column) -> Column:
    """The format by magic bytes (E2); only containers leave the JVM, and unknown bytes are text."""
    head = F.hex(F.substring(content, 1, 8))
    held = head.startswith("504B0304") | (head == "D0CF11E0A1B11AE1")
    return F.when(head.startswith("255044462D"), "pdf").when(held, _container(F.when(held, content))).otherwise("txt")
