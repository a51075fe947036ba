"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own switch by which the shuffle files of a statement go when it ends; nothing reads those of a written table again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in local tests, a folder of this process."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(context, "_pagewright_shared", None)
        if found is None:
            found = context._pagewright_shared = tempfile.mkdtemp(prefix="pagewright-")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._pagewright_path = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables from which everything that is needed has been stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._pagewright_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> bool:
    """Is a stored table within ``most`` bytes at ``row_bytes`` a row?  Asked before any broadcast."""
    return df.count() * row_bytes <= most
