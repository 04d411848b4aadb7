"""The progress ledger as a stream: recognition results arrive, the latest per recording stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factrail.operators.merging import last_per_key
from factrail.sources.buckets import BUCKETS, read_table, upsert_table

KEY = ["item_id", "channel"]


def observations(stream: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Recognition events with a watermark; repeats of one event inside it are dropped.

    Input: event_id, ts, item_id, channel, sec, error.
    """
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Results and errors per window and channel, emitted when the watermark has passed the window."""
    bad = F.coalesce(F.col("error") != "", F.lit(False))
    return events.groupBy(F.window("ts", width).alias("w"), "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad.cast("bigint")).alias("n_errors"), F.sum("sec").alias("sec")
    ).select(F.col("w.start").alias("start"), "channel", "n", "n_errors", "sec")


def fold_batch(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Latest result per (item, channel) of the old state and a new batch."""
    cols = [*KEY, "ts", "event_id", "sec", "error"]
    rows = batch.select(*cols) if state is None else state.select(*cols).unionByName(batch.select(*cols))
    return last_per_key(rows.withColumn("_o", F.struct("ts", "event_id")), KEY, "_o").drop("_o").select(*cols)


class LedgerSink:
    """foreachBatch sink: one version of a bucketed table per batch, numbered by the batch id; a batch rewrites only the
    buckets that it touches.

    A replayed batch starts from the same predecessor, so a restart gives the same state. The predecessor is the newest
    complete version of an earlier batch, whichever batches wrote one.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # the batch is read twice (its buckets, its rows): kept, so that the stream's state is not built twice
        batch.persist()
        upsert_table(batch, self.root, batch_id, KEY, fold_batch, buckets=self.buckets)
        batch.unpersist()

    def state(self) -> DataFrame:
        return read_table(self.spark, self.root)


def ledger(state: DataFrame) -> DataFrame:
    """(channel, done, failed) of the current state."""
    bad = F.coalesce(F.col("error") != "", F.lit(False))
    return state.groupBy("channel").agg(
        F.sum((~bad).cast("bigint")).alias("done"), F.sum(bad.cast("bigint")).alias("failed"))
