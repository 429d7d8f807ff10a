"""Shared helpers: the work folder, written intermediate tables, Arrow batch bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words wherever a contract counts them; everything else is part of a word.
WORD = "[^\\x20\\x09-\\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only on a local master where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ledgerspark-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet into the shared work folder and read back, which cuts its lineage.

    Any executor can read the files again, so the loss of one costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    root = work_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.toString().startswith(jvm.org.apache.hadoop.fs.Path(root).toString()):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds Arrow batches, so a batch of long texts fits in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
