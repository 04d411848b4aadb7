"""Pairwise set comparison of fact sets.

A fact set per (item, condition, view) is never collected. One aggregation turns the long fact
table into one row per distinct fact with a BIGINT that says which slots observed it; unions,
intersections and differences of any slots are then bit tests on that row, so every metric over
every pair comes out of the same pass. The aggregation key contains the fact itself, so an item
that holds a large share of all facts still spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factrail.dims import FACT_TYPES, SLOTS, Pair, Side, slot_bit, slot_bit_column
from factrail.functions.stats import gap, gap_wilson, ratio

ITEM = ("model", "item_id")
FACT_KEY = ("type", "value", "polarity")


def presence(facts: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """One row per (keys, fact) with the bit mask of the slots that hold the fact."""
    bit = slot_bit_column()
    return facts.groupBy(*keys, *FACT_KEY).agg(F.bit_or(bit).alias("mask"))


def observed_mask(observed: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """One row per item with the mask of observed slots, also those that hold no fact."""
    bit = slot_bit_column()
    return observed.groupBy(*keys).agg(F.bit_or(bit).alias("observed"))


def slot_counts(facts_presence: DataFrame, keys: Sequence[str] = ITEM, slots: Sequence[tuple[str, str]] = SLOTS) -> DataFrame:
    """(condition, view, type, n_facts, n_items, n_negative): distinct facts, items that hold any, and negative facts of every
    slot and type.

    The slots are bits until the end, so an item is a row per type and not one per type and slot. Its sums hold the facts
    of a slot in their lower half and the negative ones in the upper, for fewer than 2^31 facts of an item and type.
    """
    bits = [slot_bit(c, v) for c, v in slots]
    held = lambda bit, one: F.expr(f"CASE WHEN (mask & {bit}L) <> 0L THEN {one} ELSE 0L END")
    rows = facts_presence.select(*keys, "type", "mask", F.expr("CASE WHEN polarity = '-' THEN 4294967297L ELSE 1L END AS one"))
    per_item = rows.groupBy(*keys, "type").agg(*[F.sum(held(b, "one")).alias(f"s{i}") for i, b in enumerate(bits)], F.bit_or("mask").alias("mask"))
    sums = per_item.groupBy("type").agg(*[
        F.sum(x).alias(f"{k}{i}") for i, b in enumerate(bits)
        for k, x in (("f", F.expr(f"s{i} & 4294967295L")), ("i", held(b, "1L")), ("n", F.expr(f"shiftright(s{i}, 32)")))])
    slot = [F.struct(F.lit(c).alias("condition"), F.lit(v).alias("view"), *[
        F.col(f"{k}{i}").alias(n) for k, n in (("f", "n_facts"), ("i", "n_items"), ("n", "n_negative"))]) for i, (c, v) in enumerate(slots)]
    return sums.select("type", F.explode(F.array(*slot)).alias("s")).where("s.n_facts > 0").select(
        "s.condition", "s.view", "type", "s.n_facts", "s.n_items", "s.n_negative")


def has_any(mask: Column, side: Side) -> Column:
    return mask.bitwiseAND(F.lit(side.bits).cast("bigint")) != 0


def has_all(mask: Column, side: Side) -> Column:
    need = F.lit(side.need).cast("bigint")
    return mask.bitwiseAND(need) == need


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def item_counts(
    facts_presence: DataFrame,
    pairs: Sequence[Pair],
    observed: DataFrame | None = None,
    *,
    missing: str = "exclude",
    by_type: bool = False,
    keys: Sequence[str] = ITEM,
) -> DataFrame:
    """Long table (keys, [type], metric, retained, total, n_down) with one row per item and pair.

    ``missing="exclude"`` drops a pair of an item unless every slot on both sides was observed;
    ``missing="empty"`` reads an unobserved slot as an empty fact set. ``observed`` may carry a
    boolean column ``agree`` for the pairs that only look at agreeing observations.
    """
    if missing not in ("exclude", "empty"):
        raise ValueError(f"missing must be exclude or empty, not {missing!r}")
    columns = []
    for i, p in enumerate(pairs):
        names = ", ".join(f"'{t}'" for t in p.types or ())
        in_type = f"type IN ({names}) AND " if p.types else ""
        up, down = f"(mask & {p.up.bits}L) <> 0L", f"(mask & {p.down.bits}L) <> 0L"
        columns += [
            F.expr(f"sum(CASE WHEN {in_type}{up} AND {down} THEN 1L ELSE 0L END) AS r{i}"),
            F.expr(f"sum(CASE WHEN {in_type}{up} THEN 1L ELSE 0L END) AS t{i}"),
            F.expr(f"sum(CASE WHEN {in_type}{down} THEN 1L ELSE 0L END) AS d{i}"),
        ]
    group = [*keys, "type"] if by_type else list(keys)
    counts = facts_presence.groupBy(*group).agg(*columns)
    gated = observed is not None and missing == "exclude"
    if observed is not None:
        counts = counts.join(observed, list(keys), "left")
    agree = "coalesce(agree, false)" if observed is not None and "agree" in observed.columns else "false"
    rows = []
    for i, p in enumerate(pairs):
        need = p.up.need | p.down.need
        tests = [f"coalesce((observed & {need}L) = {need}L, false)"] if gated else []
        tests += [agree] if p.agree_only else []
        rows.append(
            f"named_struct('metric', '{p.name}', 'retained', r{i}, 'total', t{i}, 'n_down', d{i}, "
            f"'keep', {' AND '.join(tests) or 'true'})")
    return (
        counts.select(*group, F.expr(f"explode(array({', '.join(rows)})) AS m"))
        .where(F.col("m.keep"))
        .select(*group, "m.metric", "m.retained", "m.total", "m.n_down")
    )


def pooled(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled gap per key: 1 - sum(retained) / sum(total), with its Wilson interval."""
    out = counts.groupBy(*keys, "metric").agg(
        F.sum("retained").alias("retained"), F.sum("total").alias("total")
    )
    return with_gap(out)


def with_gap(df: DataFrame) -> DataFrame:
    k, n = F.col("retained"), F.col("total")
    lo, hi = gap_wilson(k, n)
    return df.select(
        "*",
        ratio(k, n).alias("retention"),
        gap(k, n).alias("gap"),
        F.round(lo, 9).alias("ci_lo"),
        F.round(hi, 9).alias("ci_hi"),
    )


def jaccard(inter: Column, a: Column, b: Column, *, empty: str = "null") -> Column:
    """Jaccard from counts; ``empty`` says what an empty union gives: null or zero."""
    value = ratio(inter, a + b - inter)
    return value if empty == "null" else F.coalesce(value, F.lit(0.0))


def common_sample(observed: DataFrame, required: Sequence[Side], keys: Sequence[str] = ITEM) -> DataFrame:
    """Items whose observed mask covers every required side."""
    return observed.where(has_all(F.col("observed"), Side(0, 0).on(*required)))


def lost_facts(facts_presence: DataFrame, down: Side, up: Side, observed: DataFrame) -> DataFrame:
    """Facts of ``up`` that ``down`` does not hold, on items where both were observed."""
    both = observed.where(has_all(F.col("observed"), up) & has_all(F.col("observed"), down))
    lost = facts_presence.where(has_any(F.col("mask"), up) & ~has_any(F.col("mask"), down))
    return lost.join(both.select(*ITEM), list(ITEM), "left_semi")


def added_facts(facts_presence: DataFrame, down: Side, up: Side, observed: DataFrame) -> DataFrame:
    return lost_facts(facts_presence, up, down, observed)


def number_value(value: Column) -> Column:
    return F.regexp_replace(value, ",", "").try_cast("double")


def classify_losses(facts_presence: DataFrame, down: Side, up: Side, observed: DataFrame) -> DataFrame:
    """One row per lost fact with ``kind``: polarity_flip, deletion, number_drift or substitution.

    No pair of (lost fact, surviving fact) is emitted. The flip test is a count per (item, value),
    the deletion test a count per (item, type); the nearest surviving number comes from the last
    number before and the first number after each lost one, found per (item, bucket of the number
    line) with the bucket edges filled from per-bucket extremes, so that one crowded item is cut
    into many sort groups.
    """
    both = observed.where(has_all(F.col("observed"), up) & has_all(F.col("observed"), down)).select(*ITEM)
    here = (
        facts_presence.where(has_any(F.col("mask"), up) | has_any(F.col("mask"), down))
        .join(both, list(ITEM), "left_semi")
        .select(
            *ITEM, *FACT_KEY,
            (has_any(F.col("mask"), up) & ~has_any(F.col("mask"), down)).alias("lost"),
            has_any(F.col("mask"), down).alias("kept"),
        )
    )
    lost = here.where("lost").select(*ITEM, *FACT_KEY, number_value(F.col("value")).alias("x"))
    down_polarity = (
        here.where("kept").groupBy(*ITEM, "value")
        .agg(F.collect_set("polarity").alias("down_polarities"))
    )
    down_types = here.where("kept").select(*ITEM, "type").distinct().withColumn("same_type", F.lit(True))
    numbers = here.where((F.col("type") == "number") & number_value(F.col("value")).isNotNull())
    nearest = nearest_kept_number(numbers)
    rel = F.least(
        F.abs(F.col("x") - F.col("below")), F.abs(F.col("x") - F.col("above"))
    ) / F.greatest(F.abs(F.col("x")), F.lit(1e-9))
    other = F.filter(F.coalesce(F.col("down_polarities"), F.array().cast("array<string>")),
                     lambda p: p != F.col("polarity"))
    kind = (
        F.when(F.size(other) > 0, "polarity_flip")
        .when(F.col("same_type").isNull(), "deletion")
        .when((F.col("type") == "number") & F.coalesce(rel < 0.5, F.lit(False)), "number_drift")
        .otherwise("substitution")
    )
    return (
        lost.join(down_polarity, [*ITEM, "value"], "left")
        .join(down_types, [*ITEM, "type"], "left")
        .join(nearest, [*ITEM, *FACT_KEY], "left")
        .select(*ITEM, *FACT_KEY, kind.alias("kind"))
    )


def nearest_kept_number(numbers: DataFrame) -> DataFrame:
    """For every lost number the nearest surviving number below and above it.

    The number line of an item is cut at powers of two of the magnitude and 64 slices inside each,
    so a hot item sorts in many small groups; the nearest value of an earlier or later bucket is
    carried by a window over the per-bucket extremes only.
    """
    from pyspark.sql import Window as W

    x = number_value(F.col("value"))
    magnitude = F.when(x == 0, F.lit(-1024)).otherwise(
        F.floor(F.log2(F.greatest(F.abs(x), F.lit(1e-300)))).cast("int"))
    inside = F.floor((F.abs(x) / F.pow(F.lit(2.0), magnitude) - 1) * 64)
    inside = F.when(x == 0, F.lit(0)).otherwise(F.least(F.greatest(inside, F.lit(0)), F.lit(63)))
    bucket = F.signum(x).cast("bigint") * ((magnitude.cast("bigint") + 2048) * 64 + inside + 1)
    rows = numbers.select(
        *ITEM, *FACT_KEY, "lost",
        F.when(F.col("kept"), x).alias("kx"), x.alias("nx"), bucket.alias("bucket"),
    )
    cell = W.partitionBy(*ITEM, "bucket")
    before = cell.orderBy("nx").rangeBetween(W.unboundedPreceding, 0)
    after = cell.orderBy(F.desc("nx")).rangeBetween(W.unboundedPreceding, 0)
    local = rows.select(
        *ITEM, *FACT_KEY, "lost", "bucket",
        F.max("kx").over(before).alias("below_here"),
        F.min("kx").over(after).alias("above_here"),
    ).where("lost")
    edges = rows.groupBy(*ITEM, "bucket").agg(F.min("kx").alias("lo"), F.max("kx").alias("hi"))
    line = W.partitionBy(*ITEM).orderBy("bucket")
    carried = edges.select(
        *ITEM, "bucket",
        F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1)).alias("below_far"),
        F.min("lo").over(line.rowsBetween(1, W.unboundedFollowing)).alias("above_far"),
    )
    return local.join(carried, [*ITEM, "bucket"], "left").select(
        *ITEM, *FACT_KEY,
        F.coalesce("below_here", "below_far").alias("below"),
        F.coalesce("above_here", "above_far").alias("above"),
    )


def agreement_strata(facts_presence: DataFrame, sides: Sequence[Side], observed: DataFrame) -> DataFrame:
    """all_three_agree / two_agree / all_differ per item, from fact-set equality of three views.

    Two sets are equal exactly when no fact is held by one of them only, so three counters per item
    replace the collected signatures. An observed item without any fact has three equal sets.
    """
    a, b, c = (has_any(F.col("mask"), s) for s in sides)
    diffs = facts_presence.groupBy(*ITEM).agg(
        _count(a != b).alias("ab"), _count(a != c).alias("ac"), _count(b != c).alias("bc")
    )
    zero = F.lit(0)
    ab, ac, bc = (F.coalesce(F.col(x), zero) == 0 for x in ("ab", "ac", "bc"))
    return (
        common_sample(observed, sides).select(*ITEM)
        .join(diffs, list(ITEM), "left")
        .select(
            *ITEM,
            F.when(ab & bc, "all_three_agree").when(ab | ac | bc, "two_agree")
            .otherwise("all_differ").alias("stratum"),
        )
    )


def dimension(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Expand every row by a short fixed list of values (no join)."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def type_dimension(df: DataFrame) -> DataFrame:
    return dimension(df, "type", FACT_TYPES)
