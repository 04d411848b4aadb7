"""Item-clustered bootstrap and permutation tests over counted cells.

An item enters a pooled statistic only through its numbers, so items with equal numbers are one cell
with a multiplicity. Two exact ways to draw with replacement are offered:

* ``slots``: draw j of replicate b picks a position on the line of items ordered by cell, by integer
  arithmetic that any engine can repeat; draws, lookup and sums happen inside the task (``draws``).
* ``multinomial``: a block of replicates draws the multiplicities of the cells in an Arrow batch; the
  work is replicates x cells and does not grow with the number of items. Cells travel in parts of at
  most PART cells: every part draws from the same generator how many items of a replicate fall to each
  part, and then, from its own, how they fall to its cells, which together is the multinomial draw of
  all cells. A row's sums are added up per replicate. Generators are keyed by (seed, group, block,
  part), so the result does not depend on the partitioning, and no group has a largest size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from factrail.operators.draws import bootstrap_sums, choice_sums, hash_number
from factrail.operators.ranking import running_totals
from factrail.session import materialise, parallelism, ship

PART = 4096
BLOCK = 128


def cells_of(items: DataFrame, group: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """(group, stats, n, start): cells in the order of their numbers, with the first position of each.

    Counting the cells is the only pass over the items. It is written once, because positions, point
    estimates and draws all start from it.
    """
    group, stats = list(group), list(stats)
    counted = materialise(items.groupBy(*group, *stats).agg(F.count(F.lit(1)).alias("n")))
    return materialise(running_totals(counted, group, stats, "n").withColumnRenamed("before", "start"))


def _parts(cells: DataFrame, group: Sequence[str], order: Sequence[str], fields: list[Column], counts: Sequence[str]) -> DataFrame:
    """(group, _part, _cell, _totals): the cells in parts of about PART, each with the list of all parts' counts.

    The parts of a group follow a hash of the cell, so a group of any size is dealt out evenly; the list of totals
    has one entry per part.
    """
    group = list(group)
    sizes = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_cells"))
    slot = F.pmod(F.xxhash64(*order), F.expr(f"(_cells - 1) div {PART} + 1")).alias("_part")
    dealt = cells.join(sizes, group).select(*group, slot, *counts, F.struct(*fields).alias("_c"))
    parts = dealt.groupBy(*group, "_part").agg(F.sort_array(F.collect_list("_c")).alias("_cell"), *[F.sum(c).alias(f"_sum_{c}") for c in counts])
    totals = parts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_part", *[f"_sum_{c}" for c in counts]))).alias("_totals"))
    return parts.join(totals, group).select(*group, "_part", "_cell", "_totals")


def _jobs(parts: DataFrame, group: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """A row for each part and block of replicates."""
    jobs = parts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK)))).withColumn(
        "_salt", hash_number(F.lit(seed), *[F.col(g) for g in group]))
    return jobs.repartition(parallelism(parts.sparkSession), *group, "_part", "_block")


def _generators(seed: int, row) -> tuple[np.random.Generator, np.random.Generator]:
    """The generator that all parts of a block share, and the part's own."""
    key = [seed, int(row["_salt"]), int(row["_block"])]
    return tuple(np.random.Generator(np.random.PCG64(np.random.SeedSequence(k))) for k in (key, [*key, int(row["_part"]) + 1]))


def multinomial_sums(cells: DataFrame, group: Sequence[str], stats: Sequence[str], *, replicates: int, seed: int) -> DataFrame:
    """As ``bootstrap_sums``, from multinomial multiplicities of the cells, for any number of cells."""
    ship(cells.sparkSession)
    group, stats = list(group), list(stats)
    fields = ["start", "n", *[F.col(s).cast("double").alias(s) for s in stats]]
    jobs = _jobs(_parts(cells, group, ["start"], fields, ["n"]), group, replicates, seed)
    schema = T.StructType(
        [cells.schema[g] for g in group]
        + [T.StructField("b", T.IntegerType())]
        + [T.StructField(s, T.DoubleType()) for s in stats]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                cell = row["_cell"]
                counts = np.array([c["n"] for c in cell], dtype=np.int64)
                values = np.array([[c[s] for s in stats] for c in cell])
                lo = int(row["_block"]) * BLOCK
                bs = np.arange(lo, min(lo + BLOCK, replicates))
                shared, own = _generators(seed, row)
                totals = np.array([t["_sum_n"] for t in row["_totals"]], dtype=np.int64)
                at = [t["_part"] for t in row["_totals"]].index(row["_part"])
                share = shared.multinomial(int(totals.sum()), totals / totals.sum(), size=len(bs))[:, at]
                sums = own.multinomial(share, counts / counts.sum()) @ values
                out = pd.DataFrame({g: [row[g]] * len(bs) for g in group})
                out["b"] = bs.astype("int32")
                for j, s in enumerate(stats):
                    out[s] = sums[:, j]
                yield out

    return jobs.mapInPandas(draw, schema).groupBy(*group, "b").agg(*[F.sum(s).alias(s) for s in stats])


def percentiles(draws: DataFrame, group: Sequence[str], statistic: str, *, rule: str = "nearest") -> DataFrame:
    """(group, lo, hi, n_boot): 95 % percentile interval of the replicates, NULL replicates left out.

    ``nearest`` takes the sorted replicates at int(.025 B) and int(.975 B) - 1, ``linear`` interpolates.
    The rows are replicates, so a group is as long as the number of draws asked for.
    """
    group = list(group)
    known = draws.where(F.col(statistic).isNotNull())
    if rule == "linear":
        q = F.percentile(statistic, F.array(F.lit(0.025), F.lit(0.975)))
        return known.groupBy(*group).agg(
            q.getItem(0).alias("ci_lo"), q.getItem(1).alias("ci_hi"), F.count(F.lit(1)).alias("n_boot"))
    w = W.partitionBy(*group)
    ranked = known.select(
        *group, statistic,
        (F.row_number().over(w.orderBy(statistic)) - 1).alias("_i"),
        F.count(F.lit(1)).over(w).alias("_n"),
    )
    lo_at = F.floor(F.col("_n") * F.lit(0.025)).cast("bigint")
    hi_at = F.floor(F.col("_n") * F.lit(0.975)).cast("bigint") - 1
    return ranked.groupBy(*group).agg(
        F.max(F.when(F.col("_i") == lo_at, F.col(statistic))).alias("ci_lo"),
        F.max(F.when(F.col("_i") == hi_at, F.col(statistic))).alias("ci_hi"),
        F.max("_n").alias("n_boot"),
    )


def excludes_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def _gap_difference() -> Column:
    ga = F.lit(1.0) - F.try_divide(F.col("ra").cast("double"), F.col("ta").cast("double"))
    gb = F.lit(1.0) - F.try_divide(F.col("rb").cast("double"), F.col("tb").cast("double"))
    return ga - gb


def bootstrap_gap_difference(
    items: DataFrame, group: Sequence[str], *, replicates: int = 10_000, seed: int = 20260916,
    method: str = "multinomial", rule: str = "nearest",
) -> DataFrame:
    """Paired bootstrap of the difference of two pooled gaps; ``items`` holds (group, ra, ta, rb, tb)."""
    group = list(group)
    stats = ["ra", "ta", "rb", "tb"]
    cells = cells_of(items, group, stats)
    point = cells.groupBy(*group).agg(F.sum("n").alias("n_items"), *[F.sum(F.col("n") * F.col(s)).alias(s) for s in stats])
    point = point.select(*group, "n_items", _gap_difference().alias("diff"))
    draw = {"slots": bootstrap_sums, "multinomial": multinomial_sums}[method]
    draws = draw(cells, group, stats, replicates=replicates, seed=seed).select(*group, "b", _gap_difference().alias("x"))
    return excludes_zero(point.join(percentiles(draws, group, "x", rule=rule), group, "left"))


def bootstrap_mean(
    items: DataFrame, group: Sequence[str], num: str, den: str, *, replicates: int = 10_000,
    seed: int = 20260918, method: str = "multinomial", rule: str = "nearest",
) -> DataFrame:
    """Bootstrap of the mean of the per-item ratios num / den (integers), with outcome counts."""
    group = list(group)
    value = F.col(num).cast("double") / F.col(den).cast("double")
    rows = items.select(*group, F.col(den).alias("_d"), F.col(num).alias("_k"), value.alias("x"))
    cells = cells_of(rows.select(*group, "_d", "_k", "x"), group, ["_d", "_k", "x"])
    n, x = F.col("n"), F.col("x")
    point = cells.groupBy(*group).agg(
        F.sum(n).alias("n_items"), (F.sum(n * x) / F.sum(n)).alias("mean"),
        F.sum(F.when(x > 1e-12, n).otherwise(0)).alias("improved"),
        F.sum(F.when(F.abs(x) <= 1e-12, n).otherwise(0)).alias("unchanged"),
        F.sum(F.when(x < -1e-12, n).otherwise(0)).alias("worsened"),
    )
    size = cells.groupBy(*group).agg(F.sum("n").alias("_m"))
    draw = {"slots": bootstrap_sums, "multinomial": multinomial_sums}[method]
    sums = draw(cells, group, ["x"], replicates=replicates, seed=seed).join(size, group).withColumn("x", F.col("x") / F.col("_m"))
    return excludes_zero(point.join(percentiles(sums.select(*group, "b", "x"), group, "x", rule=rule), group, "left"))


def joint_intervals(
    items: DataFrame, group: Sequence[str], ratios: Mapping[str, tuple[str, str | None]], *, replicates: int = 10_000,
    seed: int = 20260918, method: str = "slots", rule: str = "linear", stratum: str | None = None, weight: str | None = None,
) -> DataFrame:
    """(group, statistic, n_items, mean, ci_lo, ci_hi, n_boot, excludes_zero): many statistics from the same draws.

    A row of ``items`` is one item with all its numbers, so that one draw serves every statistic and differences between
    them are paired. A statistic is sum(a) / sum(b) over the drawn items, or their mean of ``a`` where b is None; an unknown number
    counts as zero, so an item without a statistic is left out of it by a NULL or zero in both.
    With ``stratum`` every stratum draws its own items, and a statistic is the mean of the strata weighted by ``weight``
    (a column that is constant in a stratum).
    """
    group = list(group)
    keys = group + ([stratum] if stratum else [])
    stats = sorted({c for pair in ratios.values() for c in pair if c})
    known = items.select(*keys, *[F.coalesce(F.col(c), F.lit(0).cast(items.schema[c].dataType)).alias(c) for c in stats])
    cells = cells_of(known, keys, stats)
    size = cells.groupBy(*keys).agg(F.sum("n").alias("n_items"))
    draw = {"slots": bootstrap_sums, "multinomial": multinomial_sums}[method]
    sums = draw(cells, keys, stats, replicates=replicates, seed=seed)
    whole = cells.groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(c)).cast("double").alias(c) for c in stats]).withColumn("b", F.lit(-1))
    rows = sums.unionByName(whole.select(*sums.columns)).join(size, keys)
    value = {k: F.try_divide(F.col(a), F.col(b) if b else F.col("n_items").cast("double")) for k, (a, b) in ratios.items()}
    if stratum:
        rows = rows.join(items.select(*keys, weight).distinct(), keys)
        part = lambda x: F.try_divide(F.sum(F.when(x.isNotNull(), x * F.col(weight))), F.sum(F.when(x.isNotNull(), F.col(weight))))
        rows = rows.groupBy(*group, "b").agg(F.sum("n_items").alias("n_items"), *[part(x).alias(f"_v_{k}") for k, x in value.items()])
        value = {k: F.col(f"_v_{k}") for k in value}
    long = rows.select(*group, "b", "n_items", F.explode(F.array(*[
        F.struct(F.lit(k).alias("statistic"), x.alias("x")) for k, x in value.items()])).alias("v")).select(*group, "b", "n_items", "v.*")
    long = materialise(long)
    point = long.where("b = -1").select(*group, "statistic", "n_items", F.col("x").alias("mean"))
    limits = percentiles(long.where("b >= 0"), [*group, "statistic"], "x", rule=rule)
    out = point.join(limits, [*group, "statistic"], "left")
    return out.withColumn("excludes_zero", (F.round("ci_lo", 12) > 0) | (F.round("ci_hi", 12) < 0))


def paired_intervals(
    rows: DataFrame, group: Sequence[str], unit: Sequence[str], fold: str, folds: Sequence[str], values: Mapping[str, Column],
    *, sparse: Sequence[str] = (), **draw,
) -> DataFrame:
    """(group, fold, statistic, mean, ci_lo, ci_hi, n_boot, excludes_zero): means of ``values`` in every fold, all folds and
    values of a group from the same draws of units.

    ``rows`` holds one row per unit and fold; a value may be NULL only if it is named in ``sparse``, and is then left
    out of its own mean.
    """
    inside = {f: F.col(fold) == F.lit(f) for f in folds}
    columns, ratios = [], {}
    for i, f in enumerate(folds):
        columns.append(F.coalesce(F.max(F.when(inside[f], F.lit(1.0))), F.lit(0.0)).alias(f"n{i}"))
        for name, x in values.items():
            columns.append(F.max(F.when(inside[f], x)).cast("double").alias(f"{name}{i}"))
            if name in sparse:
                columns.append(F.max(F.when(inside[f] & x.isNotNull(), F.lit(1.0)).otherwise(0.0)).alias(f"n_{name}{i}"))
            ratios[f"{name}:{f}"] = (f"{name}{i}", f"n_{name}{i}" if name in sparse else f"n{i}")
    out = joint_intervals(rows.groupBy(*group, *unit).agg(*columns), group, ratios, **draw)
    return out.select(
        *group, F.substring_index("statistic", ":", -1).alias(fold), F.substring_index("statistic", ":", 1).alias("statistic"),
        "mean", "ci_lo", "ci_hi", "n_boot", "excludes_zero").where("mean IS NOT NULL")


def wide_intervals(intervals: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group: <name>_ci_lo, <name>_ci_hi and <name>_excludes_zero for every statistic named."""
    pick = lambda k, c: F.max(F.when(F.col("statistic") == k, F.col(c)))
    return intervals.groupBy(*group).agg(*[
        pick(k, c).alias(f"{k}_{c}") for k in names for c in ("ci_lo", "ci_hi", "excludes_zero")])


def outcomes(rows: DataFrame, group: Sequence[str], x: Column, tol: float = 1e-12) -> DataFrame:
    """(group, n_items, improved, unchanged, worsened) of the values x."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(x > tol).alias("improved"),
        F.count_if(F.abs(x) <= tol).alias("unchanged"), F.count_if(x < -tol).alias("worsened"))


def permutation_test(
    rows: DataFrame, group: Sequence[str], label: str, value: str, *, replicates: int = 10_000, seed: int = 20260918,
) -> DataFrame:
    """Two-sided test of a difference of means; the labels are drawn anew for every replicate.

    The statistic needs only how many of each distinct value fall into the first group: a
    multivariate hypergeometric draw over the counted values, made in parts as the multinomial one is. The
    generator takes fewer than 10^9 rows per group; ``permutation_test_ordered`` has no such bound.
    p = (hits + 1) / (replicates + 1), NULL when a group has fewer than two rows.
    """
    group = list(group)
    cells = rows.groupBy(*group, F.col(value).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("na"))
    cells = materialise(cells)
    x, n, na = F.col("x"), F.col("n"), F.col("na")
    whole = cells.groupBy(*group).agg(F.sum("n").alias("_n"), F.sum("na").alias("n_a"), F.sum(n * x).alias("_s"), F.sum(na * x).alias("_sa"))
    n_a, n_b = F.col("n_a"), F.col("_n") - F.col("n_a")
    difference = lambda first: F.try_divide(first, n_a.cast("double")) - F.try_divide(F.col("_s") - first, n_b.cast("double"))
    ship(rows.sparkSession)
    jobs = _jobs(_parts(cells, group, ["x"], ["x", "n"], ["n", "na"]), group, replicates, seed)
    schema = T.StructType([rows.schema[g] for g in group] + [T.StructField("b", T.IntegerType()), T.StructField("first", T.DoubleType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = np.array([c["x"] for c in row["_cell"]])
                n = np.array([c["n"] for c in row["_cell"]], dtype=np.int64)
                totals = np.array([t["_sum_n"] for t in row["_totals"]], dtype=np.int64)
                taken = sum(int(t["_sum_na"]) for t in row["_totals"])
                lo = int(row["_block"]) * BLOCK
                bs = np.arange(lo, min(lo + BLOCK, replicates))
                shared, own = _generators(seed, row)
                at = [t["_part"] for t in row["_totals"]].index(row["_part"])
                share = shared.multivariate_hypergeometric(totals, taken, size=len(bs), method="marginals")[:, at]
                out = pd.DataFrame({g: [row[g]] * len(bs) for g in group})
                out["b"] = bs.astype("int32")
                out["first"] = [float(own.multivariate_hypergeometric(n, int(k), method="marginals") @ x) for k in share]
                yield out

    sums = jobs.mapInPandas(draw, schema).groupBy(*group, "b").agg(F.sum("first").alias("first"))
    hits = sums.join(whole, group).groupBy(*group).agg(
        F.count_if(F.abs(difference(F.col("first"))) >= F.abs(difference(F.col("_sa"))) - 1e-12).alias("_hits"))
    p = F.when((n_a >= 2) & (n_b >= 2), (F.col("_hits") + 1) / F.lit(replicates + 1))
    return whole.join(hits, group, "left").select(*group, "n_a", n_b.alias("n_b"), difference(F.col("_sa")).alias("diff"), p.alias("p_value"))


def permutation_test_ordered(
    rows: DataFrame, group: Sequence[str], label: str, value: str, row_id: str | None = None, *, replicates: int = 10_000, seed: int = 20260918,
) -> DataFrame:
    """The same test with a replicate's first group made of the images of the first slots under a keyed permutation of the
    positions, which any engine can repeat.

    Rows of equal value are one cell and interchangeable, so ``row_id`` is not read. The smaller of both label groups
    is drawn and summed inside the task; no row is repeated per replicate, and the rows are read once, as counted cells. ``value`` should be integral so that sums do not
    depend on their order. Fewer than 2^31 rows a group.
    """
    group = list(group)
    counted = materialise(rows.groupBy(*group, F.col(value).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_a")))
    x, n = F.col("x"), F.col("n")
    sizes = materialise(counted.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("n_a").alias("n_a"), F.sum(n * x).alias("s"), F.sum(F.col("n_a") * x).alias("s_a")))
    n_a, n_b = F.col("n_a"), F.col("n") - F.col("n_a")
    cells = running_totals(counted.drop("n_a"), group, "x", "n").withColumnRenamed("before", "start").join(
        sizes.select(*group, F.least(n_a, n_b).alias("_fewer")), group)
    drawn = choice_sums(cells, group, ["x"], F.max("_fewer"), replicates=replicates, seed=seed)

    def difference(first: Column) -> Column:
        return F.try_divide(first.cast("double"), n_a.cast("double")) - F.try_divide(
            (F.col("s") - first).cast("double"), n_b.cast("double"))

    first = F.when(n_a <= n_b, F.col("x")).otherwise(F.col("s") - F.col("x"))
    hits = drawn.join(sizes, group).select(
        *group, (F.abs(difference(first)) >= F.abs(difference(F.col("s_a"))) - 1e-15).alias("hit"))
    hits = hits.groupBy(*group).agg(F.sum(F.col("hit").cast("bigint")).alias("hits"))
    p = F.when((n_a >= 2) & (n_b >= 2), (F.col("hits") + 1) / F.lit(replicates + 1))
    return sizes.join(hits, group, "left").select(
        *group, "n_a", n_b.alias("n_b"), difference(F.col("s_a")).alias("diff"), p.alias("p_value"))


def seed_manifest(items: DataFrame, seeds: str, n: int, *, candidate_offset: int = 0) -> DataFrame:
    """Every item with its (candidate index, seed) pairs; too few seeds or a bad count is an error."""
    if n < 1:
        raise ValueError("n must be positive")
    if candidate_offset < 0:
        raise ValueError("candidate_offset must not be negative")
    values = [int(s) for s in seeds.split(",") if s.strip()]
    if len(values) < n:
        raise ValueError(f"need {n} seeds, received {len(values)}")
    pairs = F.array(*[
        F.struct(F.lit(i + candidate_offset).alias("cand_idx"), F.lit(s).cast("bigint").alias("seed"))
        for i, s in enumerate(values[:n])
    ])
    return items.select("*", F.explode(pairs).alias("p")).select("*", "p.cand_idx", "p.seed").drop("p")
