"""Shared helpers: materialised tables, partition counts, exact components of a link graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factrail.session import checkpoint_dir, materialise, parallelism, ship

__all__ = ["ASCII_UPPER", "ASCII_LOWER", "checkpoint_dir", "components", "documents", "gathered", "held_out", "lower_ascii", "materialise", "parallelism", "ship", "stored"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lower_ascii(column):
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def stored(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and lost executors do not matter."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the small tables of an iteration that one task takes.
TASK_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """As few tasks as a known number of narrow rows needs: iterations over small tables then run few, full tasks."""
    return df.coalesce(rows // TASK_ROWS + 1)


def components(edges: DataFrame) -> DataFrame:
    """Exact connected components of links (a, b): one row (node, comp) per linked node, comp the smallest node.

    Alternates large-star and small-star steps until no edge changes; each step moves every edge at most once,
    so the number of edges never grows and no component is gathered anywhere.
    """
    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    rows = edges.count()
    edges = materialise(gathered(gathered(edges, rows).distinct(), rows))
    before = signature(edges)
    few = lambda df: gathered(df, 2 * rows)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = few(few(both.where("v > u").join(low, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(low, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(few(small.where("u <> v").distinct()))
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def positions(df: DataFrame, *order, weight=None) -> DataFrame:
    """Adds before_ = number of rows (or summed weight) of all rows that sort earlier. Sorted by range partitions, whose
    totals are added up per partition; no window spans more than one partition's rows or the list of partitions."""
    from pyspark.sql import Window

    weight = F.lit(1) if weight is None else weight
    placed = stored(df.withColumn("weight_", weight.cast("bigint")).repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("slot_", F.monotonically_increasing_id()))
    part = F.shiftright("slot_", 33)
    totals = placed.groupBy(part.alias("part_")).agg(F.sum("weight_").alias("total_"))
    first = totals.select("part_", (F.sum("total_").over(Window.orderBy("part_")) - F.col("total_")).alias("first_"))
    inside = F.sum("weight_").over(Window.partitionBy("part_").orderBy("slot_")) - F.col("weight_")
    return (placed.withColumn("part_", part).withColumn("inside_", inside).join(first, "part_")
            .withColumn("before_", F.col("first_") + F.col("inside_")).drop("part_", "inside_", "first_", "slot_", "weight_"))
