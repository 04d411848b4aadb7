"""Coverage-aware task scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from factrail.functions import answers as K
from factrail.functions import observation as O
from factrail.functions.stats import ratio, wilson
from factrail.functions.text import let, q
from factrail.operators.pairing import _count
from factrail.operators.ranking import quantile
from factrail.session import materialise

SOURCES = ("internal", "asr1", "asr2", "asr3")


def graded(items: DataFrame, predictions: DataFrame, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per (model, item, condition, source): status, extracted answer and correctness.

    items (item_id, dataset, task, gold); predictions (model, item_id, condition, error, text, and per
    view v: v, v_error, v_sec). Every item is expected from every model and every (condition, source).

    An item's predictions meet it as one list, by item alone: a text travels once, not once per source, and texts that
    several conditions, sources or models share are read once. Tables dealt by item are not shuffled again.
    """
    # The models are few and the items many: the model list rides on each item as one small array.
    roster = predictions.agg(F.array_sort(F.collect_set("model")).alias("models"))
    asked = lambda v: F.col("condition").isin([c for c, s in sources if s == v])
    text = {"internal": F.coalesce(F.col("text"), F.lit(""))}
    for v in SOURCES[1:]:
        text[v] = O.completed_text(O.complete(F.col(f"{v}_error"), F.col(f"{v}_sec"), F.col(v)), F.col(v))
    said = predictions.select("item_id", F.struct(
        "model", "condition", F.coalesce(F.col("error") != "", F.lit(False)).alias("bad"),
        F.array(*[F.when(asked(v), text[v]) for v in SOURCES]).alias("texts")).alias("x"))
    found = items.select("item_id", "dataset", "task", "gold", roster.scalar().alias("models")).join(
        said.groupBy("item_id").agg(F.collect_list("x").alias("said")), "item_id", "left")

    texts = "array_distinct(flatten(transform(coalesce(said, array()), x -> CASE WHEN x.bad THEN slice(x.texts, 1, 0) ELSE filter(x.texts, t -> t IS NOT NULL) END)))"
    read = let("e", K.answer_sql("dataset", "task", "y"), f"named_struct('extracted', e, 'correct', {K.equal_sql('dataset', 'task', 'e', 'gold')})")
    found = found.withColumn("known", F.expr(texts)).withColumn("read", F.expr(f"transform(known, y -> {read})"))
    row = lambda status, field: (
        f"named_struct('model', m, 'condition', w.condition, 'source', w.source, 'status', {status}, "
        f"'extracted', CAST({field('extracted')} AS STRING), 'correct', CAST({field('correct')} AS BOOLEAN))")
    answered = "NOT x.bad AND x.texts[w.k] IS NOT NULL"
    present = row(f"CASE WHEN {answered} THEN 'ok' ELSE 'error' END",
                  lambda f: f"CASE WHEN {answered} THEN read[CAST(array_position(known, x.texts[w.k]) AS INT) - 1].{f} END")
    wanted = ", ".join(f"named_struct('condition', {q(c)}, 'source', {q(s)}, 'k', {SOURCES.index(s)})" for c, s in sources)
    each = let("p", "filter(coalesce(said, array()), x -> x.model = m AND x.condition = w.condition)",
               f"CASE WHEN size(p) = 0 THEN array({row(q('missing'), lambda f: 'NULL')}) ELSE transform(p, x -> {present}) END")
    rows = f"explode(flatten(transform(models, m -> flatten(transform(array({wanted}), w -> {each})))))"
    return found.select("item_id", "dataset", "task", F.expr(f"{rows} AS g")).select(
        "g.model", "item_id", "dataset", "task", "g.condition", "g.source", "g.status", "g.extracted", "g.correct")


def coverage_scores(rows: DataFrame, keys: Sequence[str] = ("model", "dataset", "condition", "source")) -> DataFrame:
    """Counts and accuracies; ``accuracy`` and its interval stay NULL until every item has a clean answer."""
    s = F.col("status")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), _count(s != "missing").alias("n_present"), _count(s == "error").alias("n_errors"),
        _count(F.col("extracted").isNotNull()).alias("n_extracted"), _count(F.coalesce("correct", F.lit(False))).alias("n_correct"))
    n, k = F.col("n_items"), F.col("n_correct")
    available = F.col("n_present") - F.col("n_errors")
    ready = (F.col("n_present") == n) & (F.col("n_errors") == 0)
    lo, hi = wilson(k, n)
    return agg.select(
        *keys, "n_items", "n_present", (n - F.col("n_present")).alias("n_missing"), "n_errors", available.alias("n_available"),
        "n_extracted", "n_correct", ratio(available, n).alias("coverage"), ratio(k, available).alias("accuracy_on_available"),
        ratio(k, n).alias("lower_bound"), F.when(ready, ratio(k, n)).alias("accuracy"), ready.alias("ready"),
        F.when(ready, F.round(lo, 9)).alias("ci_lo"), F.when(ready, F.round(hi, 9)).alias("ci_hi"))


def by_task(rows: DataFrame) -> DataFrame:
    ok = rows.where("status = 'ok'")
    agg = ok.groupBy("model", "dataset", F.coalesce("task", "dataset").alias("task"), "condition", "source").agg(
        F.count(F.lit(1)).alias("n"), _count(F.col("correct")).alias("n_correct"))
    return agg.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n")))


def output_mode_gap(scores: DataFrame) -> DataFrame:
    """LISTEN - SPEAK accuracy of the internal text per model and dataset, NULL unless both are complete."""
    pick = lambda c: F.max(F.when((F.col("condition") == c) & (F.col("source") == "internal"), F.col("accuracy")))
    return scores.groupBy("model", "dataset").agg(
        pick("LISTEN").alias("listen"), pick("SPEAK").alias("speak"), F.bool_and("ready").alias("ready")
    ).withColumn("output_mode_gap", F.col("listen") - F.col("speak"))


# Overlapping duration strata, lower bound exclusive, upper bound inclusive.
STRATA = {"all": (None, None), "le15": (None, 15), "15to30": (15, 30), "le30": (None, 30), "gt30": (30, None)}


def _in_strata(rows: DataFrame) -> DataFrame:
    """A copy of every row for each stratum that its duration falls into."""
    d = F.col("duration")
    member = []
    for name, (lo, hi) in STRATA.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (d > lo)
        if hi is not None:
            inside = inside & (d <= hi)
        member.append(F.when(inside, F.lit(name)))
    return rows.withColumn("stratum", F.explode(F.filter(F.array(*member), lambda s: s.isNotNull())))


def drop_intervals(rows: DataFrame, keys: Sequence[str], **draw) -> DataFrame:
    """(keys, stratum, statistic): the mean paired drop of every view in every stratum with its interval; the views of a
    stratum are drawn together."""
    from factrail.operators.resampling import joint_intervals

    drops = _in_strata(rows).select(*keys, "stratum", *[
        (F.col("correct_internal").cast("bigint") - F.col(f"correct_{s}").cast("bigint")).alias(f"drop_{s}") for s in SOURCES[1:]])
    return joint_intervals(drops, [*keys, "stratum"], {f"drop_{s}": (f"drop_{s}", None) for s in SOURCES[1:]}, **draw)


def duration_strata(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stratum): accuracy per source and paired drops against the internal text.

    rows (keys, duration, correct_internal, correct_asr1..3), read once and counted by their numbers. A row is placed in its strata by an
    expression over the fixed bounds, so no range join is needed; empty strata stay with n = 0.
    """
    right = [f"correct_{s}" for s in SOURCES]
    cells = materialise(rows.groupBy(*keys, "duration", *right).agg(F.count(F.lit(1)).alias("_n")))
    placed, n = _in_strata(cells), F.col("_n")
    mean = lambda x: F.try_divide(F.sum(n * x), F.sum(F.when(x.isNotNull(), n)).cast("double"))
    acc = lambda s: mean(F.col(f"correct_{s}").cast("double"))
    agg = placed.groupBy(*keys, "stratum").agg(
        F.sum(n).alias("n"), mean(F.col("duration")).alias("mean_duration"), F.max("duration").alias("max_duration"),
        *[acc(s).alias(f"accuracy_{s}") for s in SOURCES],
        *[(acc("internal") - acc(s)).alias(f"drop_{s}") for s in SOURCES[1:]])
    counted = placed.groupBy(*keys, "stratum", "duration").agg(F.sum(n).alias("_n"))
    agg = agg.join(quantile(counted, [*keys, "stratum"], "duration", "_n", 0.5, "median_duration"), [*keys, "stratum"], "left")
    every = cells.select(*keys).distinct().withColumn("stratum", F.explode(F.array(*[F.lit(s) for s in STRATA])))
    return every.join(agg, [*keys, "stratum"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def answer_drops(rows: DataFrame, keys: Sequence[str], view: str) -> DataFrame:
    """(keys, k, one): per-item accuracy drop of a view as an integer ratio, ready for the bootstrap."""
    k = F.col("correct_internal").cast("bigint") - F.col(f"correct_{view}").cast("bigint")
    return rows.select(*keys, k.alias("k"), F.lit(1).cast("bigint").alias("one"))


def require_one_dataset(items: DataFrame) -> DataFrame:
    """The manifest, or an error on its rows when it names more than one dataset."""
    n = items.agg(F.count_distinct("dataset").alias("n"))
    message = F.lit("a manifest must hold exactly one dataset")
    return items.where(F.when(n.scalar() == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def require_count(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, or an error when there are not exactly ``expected``."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    message = F.lit(f"expected a complete set of {expected} rows")
    return rows.where(F.when(n.scalar() == expected, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))

