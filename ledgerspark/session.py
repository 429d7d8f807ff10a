"""Session helpers: the shared work folder, written intermediate tables, a session for local use."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the results assume."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # notes the caller's line for every expression built, which costs more than building it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only on a local master where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ledgerspark-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written once to the shared work folder, a folder for each value of a column if asked, and read back: its lineage ends here."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few rows as a relation whose size the planner knows, so that it can broadcast them.

    Rows given to createDataFrame() become an RDD of unknown size, which joins by a shuffle of both sides.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)
    columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), shape)
