"""Filings validated as they arrive, and findings published in small batches.

The same plans as in batch run on each micro-batch of facts; findings go to a sink per batch. Counters of
findings over event time use windows with a watermark, so late filings within it still count.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Validator = Callable[[DataFrame], DataFrame]


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a relation as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def publish(rows: DataFrame, validate: Validator, sink: str, checkpoint: str) -> StreamingQuery:
    """Runs validate on each micro-batch and appends its findings to a Parquet folder.

    The batch's number is part of the path, so a batch that is run again after a failure replaces its own files.
    """

    def write(batch: DataFrame, number: int) -> None:
        validate(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finding_rates(findings: DataFrame, at: str = "at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings by rule and window of event time."""
    return findings.withWatermark(at, late).groupBy(F.window(at, window), "rule_id").agg(F.count("*").alias("findings"))


def stop_all(spark: SparkSession, tag: str | None = None) -> None:
    """Stops the session's streams, and the jobs that run under a tag (see tagged)."""
    for query in spark.streams.active:
        query.stop()
    if tag is not None:
        spark.sparkContext.cancelJobsWithTag(tag)


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry the tag, so that they can be cancelled without any others."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def progress(query: StreamingQuery, seconds: float = 0.1) -> Iterator[dict]:
    """A stream's batches as they finish: number, rows, rows a second; at most one report in so many seconds, and the last."""
    shown = -1
    while True:
        active, last = query.isActive, query.lastProgress
        if last is not None and last["batchId"] > shown:
            shown = last["batchId"]
            yield {"batch": shown, "rows": last["numInputRows"], "rows_per_second": last["processedRowsPerSecond"]}
        if not active:
            return
        time.sleep(seconds)
