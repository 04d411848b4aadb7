"""Runs the ledger stream over files that arrive in a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factrail.session import checkpoint_dir
from factrail.streaming import ledger as L


def as_observations(events: DataFrame) -> DataFrame:
    """Events as recognition results: user = recording, event type = channel, value = seconds."""
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("item_id"), F.col("event_type").alias("channel"), F.col("value").alias("sec"),
        F.when(F.col("event_id") % 10 == 0, "timeout").alias("error"))


def _source(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def append_windows(source: DataFrame, root: str, *, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Adds the windows that the watermark has passed to the table below ``root`` and returns the whole table.

    Repeats of an event within the watermark count once and events behind it are dropped; the keys and open windows are
    kept in the state store, evicted by the watermark, and found again below ``root`` by the next call. Every window is
    written once, by a sink that lists whole batches only.
    """
    counts = L.windowed_counts(L.observations(as_observations(source), late=late), width)
    job = (
        counts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/windows")
        .option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start())
    job.awaitTermination()
    return source.sparkSession.read.schema(counts.schema).parquet(f"{root}/windows")


def replay_windows(spark: SparkSession, path: str) -> DataFrame:
    """Stream everything that is there now into closed windows."""
    return append_windows(_source(spark, path), f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}")


def replay_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Stream everything that is there now through the watermark and the upsert sink, then read the ledger."""
    root = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    sink = L.LedgerSink(spark, f"{root}/state")
    stream = L.observations(as_observations(_source(spark, path)))
    job = (
        stream.writeStream.outputMode("append").foreachBatch(sink)
        .option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start())
    job.awaitTermination()
    return L.ledger(sink.state())
