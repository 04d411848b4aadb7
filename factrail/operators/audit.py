"""Audit sampling, blinding, validation and merging of human labels.

Samples are of a fixed size, so a cell never needs more than the first ``n`` of its hash order; the
``rn <= n`` filters let Spark cut each partition before the shuffle. Final orders are over the
sample only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factrail.functions.stats import ratio
from factrail.operators.pairing import _count

ANNOTATORS = ("annotator_1", "annotator_2")
# Strata in drawing order and their share of an enriched sample.
ENRICHED = (("all_differ", 0.40), ("two_agree", 0.35), ("all_three_agree", None))
IDENTITY = ("run_id", "model", "item_id")


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def quotas(n: int) -> dict[str, int]:
    first, second = round(n * ENRICHED[0][1]), round(n * ENRICHED[1][1])
    return {"all_differ": first, "two_agree": second, "all_three_agree": n - first - second}


def enriched_sample(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, disagreement first, models and categories in turn.

    Inside a stratum the (model, category) cells give one row each per round, every cell in descending
    hash order; unfilled places are taken from all remaining rows in ascending order of a second hash.
    Fewer than ``n`` candidates raise an error when the rows are computed.
    """
    s = str(seed)
    cell_hash = sha(s, F.concat_ws(",", "model", "category"), F.col("run_id"), F.col("item_id"))
    fill_hash = sha(s, "fill", F.col("run_id"), F.col("model"), F.col("item_id"))
    rows = candidates.dropDuplicates(list(IDENTITY)).withColumn("_h", cell_hash).withColumn("_f", fill_hash)
    by_cell = W.partitionBy("stratum", "model", "category").orderBy(F.desc("_h"))
    short = rows.withColumn("_rn", F.row_number().over(by_cell)).where(F.col("_rn") <= n)
    in_turn = W.partitionBy("stratum").orderBy("_rn", "model", "category")
    quota = F.lit(0)
    for stratum, size in quotas(n).items():
        quota = F.when(F.col("stratum") == stratum, F.lit(size)).otherwise(quota)
    chosen = short.withColumn("_turn", F.row_number().over(in_turn)).where((F.col("_turn") <= n) & (F.col("_turn") <= quota))
    rest = rows.join(chosen.select(*IDENTITY), list(IDENTITY), "left_anti").orderBy("_f", *IDENTITY).limit(n)
    # At most 2n rows from here on.
    both = chosen.select(*candidates.columns, F.lit(0).alias("_late"), F.lit("").alias("_f")).unionByName(
        rest.select(*candidates.columns, F.lit(1).alias("_late"), "_f"))
    sample = both.orderBy("_late", "_f", *IDENTITY).limit(n).drop("_late", "_f")
    number = F.row_number().over(W.orderBy("stratum", "model", "category", "item_id"))
    # One row whatever the sample holds, so that an empty one fails too.
    found = sample.agg(F.count(F.lit(1)).alias("_found")).select(
        F.when(F.col("_found") < n, F.raise_error(F.format_string(f"cannot select {n} rows from %d candidates", "_found")).cast("int")).otherwise(F.lit(1)).alias("_enough"))
    sample = found.where("_enough = 1").join(sample, F.lit(True), "left").drop("_enough")
    return sample.withColumn("audit_id", F.format_string("three_asr_%03d", number))


def apportion(weights: DataFrame, keys: Sequence[str], total: Column, over: Sequence[str]) -> DataFrame:
    """Largest-remainder shares of ``total`` among the rows of ``over`` by their weight column ``w``."""
    pool = F.sum("w").over(W.partitionBy(*over))
    exact = total.cast("double") * F.col("w") / pool
    out = weights.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    left = total - F.sum("_base").over(W.partitionBy(*over))
    order = W.partitionBy(*over).orderBy(F.desc(F.col("_exact") - F.col("_base")), *keys)
    return out.withColumn("_left", left).withColumn("_o", F.row_number().over(order)).withColumn(
        "quota", F.col("_base") + F.when(F.col("_o") <= F.col("_left"), 1).otherwise(0)).drop("_exact", "_base", "_left", "_o")


def proportional_sample(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """Strata, then models inside a stratum, in proportion to the pool; rows by ascending hash.

    Rows are identified by (run, model, item), so one item may stand for two models.
    """
    rows = candidates.dropDuplicates(list(IDENTITY))
    cells = rows.groupBy("stratum", "model").agg(F.count(F.lit(1)).alias("w"))
    strata = cells.groupBy("stratum").agg(F.sum("w").alias("w")).withColumn("_all", F.lit(1))
    by_stratum = apportion(strata, ["stratum"], F.lit(n).cast("bigint"), ["_all"]).select("stratum", F.col("quota").alias("_amount"))
    by_model = apportion(cells.join(by_stratum, "stratum"), ["model"], F.col("_amount"), ["stratum"]).select("stratum", "model", "quota")
    h = sha(str(seed), F.col("run_id"), F.col("item_id"))
    w = W.partitionBy("stratum", "model").orderBy("_h", "run_id", "item_id")
    ranked = rows.withColumn("_h", h).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return ranked.join(by_model, ["stratum", "model"]).where(F.col("_rn") <= F.col("quota")).select(*candidates.columns)


def fixed_per_group(rows: DataFrame, group: Sequence[str], k: int, seed: int, key: str) -> DataFrame:
    """``k`` rows per group in ascending hash order."""
    h = sha(str(seed), F.col(key))
    w = W.partitionBy(*group).orderBy("_h", key)
    return rows.withColumn("_h", h).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_h", "_rn")


def stratum_weights(candidates: DataFrame) -> DataFrame:
    n = candidates.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", ratio(F.col("n"), F.sum("n").over(W.partitionBy())))


def packet_summary(rows: DataFrame, label: str) -> DataFrame:
    """(source, dimension, value, n): counts by stratum, by model and by category."""
    g = rows.groupingSets([["stratum"], ["model"], ["category"]], "stratum", "model", "category").agg(F.count(F.lit(1)).alias("n"))
    dim = F.when(F.col("stratum").isNotNull(), "stratum").when(F.col("model").isNotNull(), "model").otherwise("category")
    return g.select(F.lit(label).alias("source"), dim.alias("dimension"), F.coalesce("stratum", "model", "category").alias("value"), "n")


def audit_candidates(predictions: DataFrame, strata: DataFrame) -> DataFrame:
    """Recordings without an error, with audio and three completed transcripts, and a known stratum."""
    ok = predictions.where("coalesce(error, '') = '' AND coalesce(audio, '') <> ''")
    ok = ok.where(F.col("asr1").isNotNull() & F.col("asr2").isNotNull() & F.col("asr3").isNotNull())
    return ok.join(strata, ["model", "item_id"])


def packet(candidates: DataFrame) -> DataFrame:
    """The nested packet row: transcripts in a struct; labels are NULL until someone gives them."""
    blank = lambda: F.struct(
        F.lit(None).cast("string").alias("transcript"), F.lit(None).cast("array<struct<type:string,value:string,polarity:string>>").alias("facts"),
        F.lit(None).cast("string").alias("notes"))
    return candidates.withColumn("asr", F.struct("asr1", "asr2", "asr3")).withColumn(
        "human", F.struct(blank().alias("annotator_1"), blank().alias("annotator_2"), blank().alias("adjudicated")))


def blind_sheet(master: DataFrame, annotator: str, seed: int) -> DataFrame:
    """What an annotator sees: id, audio, empty label; in an order of their own."""
    if annotator not in ANNOTATORS:
        raise ValueError(f"unsupported annotator: {annotator}")
    h = sha(str(seed), annotator, F.col("audit_id"))
    null = F.lit(None).cast("string")
    return master.select(
        "audit_id", "audio", null.alias("transcript"), null.alias("notes"), h.alias("sort_key")).orderBy("sort_key")


def sheet_violations(master: DataFrame, sheet: DataFrame) -> DataFrame:
    """(audit_id, rule) for a sheet (audit_id, audio, transcript, facts) against its master (audit_id, audio)."""
    m = master.select("audit_id", F.col("audio").alias("_audio"))
    j = sheet.join(m, "audit_id", "left")

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select("audit_id", F.lit(name).alias("rule"))

    bad_fact = F.exists("facts", lambda f: (F.coalesce(F.trim(f["type"]), F.lit("")) == "") | (F.coalesce(F.trim(f["value"]), F.lit("")) == "")
                        | ~F.coalesce(f["polarity"], F.lit("+")).isin("+", "-"))
    out = rule(j.where(F.col("_audio").isNull()), "unknown id")
    out = out.unionByName(rule(sheet.groupBy("audit_id").count().where("count > 1"), "duplicate id"))
    out = out.unionByName(rule(j.where(F.col("_audio").isNotNull() & ~F.col("audio").eqNullSafe(F.col("_audio"))), "audio changed"))
    out = out.unionByName(rule(sheet.where(F.col("transcript").isNull()), "no transcript"))
    out = out.unionByName(rule(sheet.where(F.col("facts").isNull()), "no fact list"))
    out = out.unionByName(rule(sheet.where(F.coalesce(bad_fact, F.lit(False))), "invalid fact"))
    return out.unionByName(rule(m.join(sheet, "audit_id", "left_anti"), "missing id"))


def fail_on(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """The rows, or an error that names the first violation."""
    first = violations.agg(F.min(F.concat_ws(": ", "rule", "audit_id")).alias("v"))
    problem = first.scalar()
    return rows.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))


def merge_annotators(master: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The master with both labels; sheets must be valid and complete, and labels must not exist yet."""
    bad = sheet_violations(master, first).unionByName(sheet_violations(master, second))
    if "annotator_1" in master.columns:
        have = master.where("annotator_1 IS NOT NULL OR annotator_2 IS NOT NULL").select("audit_id", F.lit("already labelled").alias("rule"))
        bad = bad.unionByName(have)
        master = master.drop("annotator_1", "annotator_2")
    pick = lambda s, name: s.select("audit_id", F.struct("transcript", "facts").alias(name))
    both = master.join(pick(first, "annotator_1"), "audit_id").join(pick(second, "annotator_2"), "audit_id")
    return fail_on(both, bad)


def adjudication_sheet(merged: DataFrame, seed: int) -> DataFrame:
    """Both labels as A and B, swapped by hash, rows in hash order; nothing automatic is shown."""
    swap = F.conv(F.substring(sha(str(seed), "adjudication", F.col("audit_id")), 1, 1), 16, 10).cast("int") % 2 == 1
    a, b = F.col("annotator_1"), F.col("annotator_2")
    return merged.select(
        "audit_id", "audio", F.when(swap, b).otherwise(a).alias("candidate_a"), F.when(swap, a).otherwise(b).alias("candidate_b"),
        sha(str(seed), "adjudication-order", F.col("audit_id")).alias("sort_key")).orderBy("sort_key")


def merge_adjudication(merged: DataFrame, sheet: DataFrame) -> DataFrame:
    bad = sheet_violations(merged, sheet)
    if "adjudicated" in merged.columns:
        have = merged.where("adjudicated IS NOT NULL").select("audit_id", F.lit("already adjudicated").alias("rule"))
        bad, merged = bad.unionByName(have), merged.drop("adjudicated")
    return fail_on(merged.join(sheet.select("audit_id", F.struct("transcript", "facts").alias("adjudicated")), "audit_id"), bad)


def label_agreement(labels: DataFrame) -> DataFrame:
    """Disagreements and mean word error of two transcripts (columns t1, t2, wer), unknown errors left out."""
    different = F.trim("t1") != F.trim("t2")
    out = labels.agg(F.count(F.lit(1)).alias("n_items"), _count(different).alias("n_disagreements"), F.avg("wer").alias("mean_transcript_wer"))
    return out.withColumn("agreement_rate", 1.0 - ratio(F.col("n_disagreements"), F.col("n_items")))


def completion(labels: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Labelled rows per role (a boolean column each) and whether every row has every label."""
    n = F.count(F.lit(1))
    out = labels.agg(n.alias("n_items"), *[_count(F.coalesce(F.col(r), F.lit(False))).alias(r) for r in roles])
    ready = F.col("n_items") > 0
    for r in roles:
        ready = ready & (F.col(r) == F.col("n_items"))
    return out.withColumn("ready", ready)


def human_anchor(retained: DataFrame, weights: DataFrame, observers: Sequence[str]) -> DataFrame:
    """(scope, observer): item-macro and fact-micro retention per stratum, overall, and stratum-weighted.

    retained (stratum, n_plan, k_<observer>). The weighted estimate is the sum of weight times the mean
    of the stratum over the strata.
    """
    long = retained.where("n_plan > 0").select(
        "stratum", "n_plan", F.explode(F.array(*[F.struct(F.lit(o).alias("observer"), F.col(f"k_{o}").alias("k")) for o in observers])).alias("o"))
    long = long.select("stratum", "n_plan", "o.observer", "o.k")
    macro, micro = F.avg(ratio(F.col("k"), F.col("n_plan"))), ratio(F.sum("k"), F.sum("n_plan"))
    per = long.groupBy("stratum", "observer").agg(F.count(F.lit(1)).alias("n_items"), macro.alias("item_macro"), micro.alias("fact_micro"))
    overall = long.groupBy("observer").agg(F.count(F.lit(1)).alias("n_items"), macro.alias("item_macro"), micro.alias("fact_micro"))
    w = per.join(weights.select("stratum", "weight"), "stratum").groupBy("observer").agg(
        F.sum("n_items").alias("n_items"), (F.sum(F.col("weight") * F.col("item_macro")) / F.sum("weight")).alias("item_macro"),
        (F.sum(F.col("weight") * F.col("fact_micro")) / F.sum("weight")).alias("fact_micro"))
    return (
        per.withColumnRenamed("stratum", "scope")
        .unionByName(overall.withColumn("scope", F.lit("all")))
        .unionByName(w.withColumn("scope", F.lit("weighted")))
    )


def content_checksum(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A checksum that does not depend on row order: count, sum and xor of row hashes."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def plan_fallback(main: DataFrame, first: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts of each wanted key from the first cache if it knows the key, else from the main one."""
    known = first.select(*keys).distinct()
    a = first.join(wanted, list(keys), "left_semi").withColumn("source", F.lit("resample"))
    b = main.join(wanted, list(keys), "left_semi").join(known, list(keys), "left_anti").withColumn("source", F.lit("main"))
    return a.unionByName(b)
