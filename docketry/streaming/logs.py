"""Streams of log and event rows (an extension: batch semantics carried over to Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.usage import suppress_repeats


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def window_counts(events: DataFrame, ts: str, by: str, size: str, late: str) -> DataFrame:
    """(start, by, n) per tumbling window; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def repeat_suppressor(spark: SparkSession, key: str, ts: str, seconds: int, folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step with the state of the batch operator: the time of the last kept event of each key.

    Batch n reads the state that batch n - 1 left under `folder`/state and writes
    (key, ts, kept) and its own state under its number, so that a batch that is
    repeated after a failure overwrites itself and nothing else.
    """

    def step(batch: DataFrame, number: int) -> None:
        events = batch.select(key, ts, F.lit(True).alias("fresh"))
        if number:
            events = events.unionByName(spark.read.parquet(f"{folder}/state/{number - 1}").select(key, ts, F.lit(False).alias("fresh")))
        marked = suppress_repeats(events, key, ts, seconds).persist()
        marked.where("fresh").select(key, ts, "kept").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        marked.where("kept").groupBy(key).agg(F.max(ts).alias(ts)).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        marked.unpersist()

    return step
