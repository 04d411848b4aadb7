"""Writers: write-once artifacts, stable nested output, snapshot tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_once_json(df: DataFrame, path: str) -> None:
    """Write an artifact that may hold human labels; an existing one is never replaced."""
    df.write.mode("errorifexists").json(path)


def stable_facts(column: str) -> Column:
    """A fact array in one order: by type, value, polarity."""
    return F.array_sort(F.array_distinct(column))


def write_facts_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("run_id", "model")) -> None:
    """The materialised extraction or fact table, partitioned so that a run or model prunes files."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_snapshot(df: DataFrame, root: str, version: int, mode: str = "errorifexists") -> str:
    """One immutable folder per version: readers of the old version are never disturbed.

    The version counts once its name is in the list below ``root``, which is written after the data, so a
    half-written version is never read.
    """
    path = f"{root}/v={version:09d}"
    df.write.mode(mode).parquet(path)
    df.sparkSession.range(1).select(F.lit(version).cast("bigint").alias("version")).coalesce(1).write.mode(mode).parquet(f"{root}/complete/n={version:09d}")
    return path


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest complete version below ``root``, or the newest one older than ``before``."""
    try:
        versions = spark.read.schema("version bigint, n string").parquet(f"{root}/complete")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.where(F.lit(True) if before is None else F.col("version") < before).agg(F.max("version")).first()[0]


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version below ``root``; only its files are read."""
    version = latest_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(f"{root}/v={version:09d}")


def item_scores(facts: DataFrame) -> DataFrame:
    """Per-item export: (model, item_id, scores) with scores a map from condition to its sorted facts.

    An item's facts come from a few texts, so a row is as large as those. They are shuffled once, by item.
    """
    fact = F.struct("type", "value", "polarity")
    sets = facts.repartition("model", "item_id").groupBy("model", "item_id", "condition").agg(F.array_sort(F.collect_set(fact)).alias("facts"))
    return sets.groupBy("model", "item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "facts")))).alias("scores"))
