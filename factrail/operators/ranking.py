"""Ranks and running totals over long groups without a single-task window.

A group (a model, a run) can hold most of the rows, so a plain ``Window.partitionBy(group)`` would
sort it in one task. Equal values are counted first; the distinct values are then dealt to range
partitions, whose number grows with their count, the totals of the partitions give each its offset,
and the window runs inside (group, partition). The result is exact whatever the cut points are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from factrail.functions.stats import ratio
from factrail.session import materialise


#: Distinct values that one task sorts.
TASK_ROWS = 250_000


def running_totals(df: DataFrame, group: Sequence[str], value: str | Sequence[str], weight: str) -> DataFrame:
    """Adds ``before``: the weight of all smaller values of the group. Values (one column or several) are unique per group.

    ``group`` may be empty. The order of a column is Spark's: NULL first, strings by all their bytes.
    """
    group, value = list(group), [value] if isinstance(value, str) else list(value)
    parts = df.count() // TASK_ROWS + 1
    placed = materialise(df.repartitionByRange(parts, *group, *value).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_part").agg(F.sum(weight).alias("_w"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*group, "_part").orderBy(*value).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [*group, "_part"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_part", "_inside", "_offset")
    )


def average_ranks(counted: DataFrame, group: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """(group, value, out): the average rank of every distinct value, ties sharing their mean rank."""
    per_value = counted.groupBy(*group, value).agg(F.sum(weight).alias("_n"))
    return running_totals(per_value, group, value, "_n").select(
        *group, value, (F.col("before") + (F.col("_n") + 1) / 2.0).alias(out)
    )


def quantile(counted: DataFrame, group: Sequence[str], value: str, weight: str, share: float, out: str) -> DataFrame:
    """(group, out): the exact quantile of the values, each counted ``weight`` times, between two neighbours by straight line.

    Rows are unique by (group, value); NULL values don't count and a group without others has no row. Nothing is
    buffered: the two values are those whose running totals hold the wanted places. ``group`` may be empty.
    """
    group = list(group)
    known = counted.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*group, value, weight)
    placed = materialise(running_totals(known, group, value, weight))
    totals = placed.groupBy(*group).agg(F.sum(weight).alias("_total"))
    if group:
        placed = placed.join(totals, group)
    else:
        placed = placed.withColumn("_total", totals.select("_total").scalar())
    place = (F.col("_total") - 1) * F.lit(share)
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col(weight))
    ends = placed.groupBy(*group).agg(
        F.max(F.when(holds(F.floor(place)), F.col(value).cast("double"))).alias("_lo"),
        F.max(F.when(holds(F.ceil(place)), F.col(value).cast("double"))).alias("_hi"), F.max(place - F.floor(place)).alias("_f"))
    line = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - F.col("_f")) * F.col("_lo") + F.col("_f") * F.col("_hi"))
    return ends.where("_lo IS NOT NULL").select(*group, line.alias(out))


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """(group, n, rho) over rows where both values are known; NULL below 3 rows or without variance.

    The rows are counted per (x, y) in one pass, which is written once; ranks and sums use the counts.
    """
    group = list(group)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = materialise(known.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("_c")))
    ranked = (
        cells.join(average_ranks(cells, group, x, "_c", "_rx"), [*group, x])
        .join(average_ranks(cells, group, y, "_c", "_ry"), [*group, y])
        .join(cells.groupBy(*group).agg(F.sum("_c").alias("_total")), group)
    )
    c = F.col("_c").cast("double")
    middle = (F.col("_total") + 1) / 2.0
    dx, dy = F.col("_rx") - middle, F.col("_ry") - middle
    sums = ranked.groupBy(*group).agg(
        F.max("_total").alias("n"),
        F.sum(c * dx * dy).alias("_xy"),
        F.sum(c * dx * dx).alias("_xx"),
        F.sum(c * dy * dy).alias("_yy"),
    )
    rho = F.when(
        (F.col("n") >= 3) & (F.col("_xx") > 0) & (F.col("_yy") > 0),
        ratio(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")),
    )
    return sums.select(*group, "n", rho.alias("rho"))
