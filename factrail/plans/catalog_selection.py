"""Registered queries: candidate selection, budgets, resampling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factrail.dims import TEXT_LISTEN, VIEWS, Pair, headline_pairs, planned, spoken
from factrail.functions.stats import r6
from factrail.operators import pairing as P
from factrail.operators import resampling as B
from factrail.operators import selection as S
from factrail.operators.pairing import ITEM
from factrail.plans import fixtures as X
from factrail.plans import metrics as M
from factrail.plans.catalog_paths import CONTRAST_SQL, observed, presence, sql_item_counts
from factrail.plans.oracle_fixtures import with_fx
from factrail.plans.registry import query
from factrail.session import materialise

HASH = "CAST(('0x' || substr(md5({0}), 1, 15)) AS BIGINT)"

# One row per (item, candidate) with the counts every selector needs.
_agg = ", ".join(
    [f"CAST(sum(CASE WHEN {v} THEN 1 ELSE 0 END) AS BIGINT) AS d_{v}" for v in VIEWS]
    + [f"CAST(sum(CASE WHEN {v} AND in_plan THEN 1 ELSE 0 END) AS BIGINT) AS i_{v}" for v in VIEWS]
    + [f"CAST(sum(CASE WHEN {a} AND {b} THEN 1 ELSE 0 END) AS BIGINT) AS x_{a}_{b}" for a, b in S.view_pairs()])
_held = ", ".join(f"bool_or(c.view='{v}') AS {v}" for v in VIEWS)
COUNT_NAMES = [f"d_{v}" for v in VIEWS] + [f"i_{v}" for v in VIEWS] + [f"x_{a}_{b}" for a, b in S.view_pairs()]


def sql_counts(by_type: bool = False) -> dict[str, str]:
    t = ", type" if by_type else ""
    return {
        "held": f"SELECT c.model, c.item_id, c.cand_idx, c.type, c.value, c.polarity, {_held} FROM fx_candidates c GROUP BY ALL",
        "marked": """SELECT h.*, p.value IS NOT NULL AS in_plan FROM held h LEFT JOIN fx_plan p
 ON p.model=h.model AND p.item_id=h.item_id AND p.type=h.type AND p.value=h.value AND p.polarity=h.polarity""",
        "cc": f"SELECT model, item_id, cand_idx{t}, {_agg} FROM marked GROUP BY model, item_id, cand_idx{t}",
        "up": f"SELECT model, item_id{t}, count(*) AS n_up FROM fx_plan GROUP BY model, item_id{t}",
        "cands": f"SELECT g.model, g.item_id, g.cand_idx{', u.type' if by_type else ''}, u.n_up, "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNT_NAMES)
        + " FROM fx_grid g JOIN up u ON u.model=g.model AND u.item_id=g.item_id LEFT JOIN cc ON cc.model=g.model AND cc.item_id=g.item_id AND cc.cand_idx=g.cand_idx"
        + (" AND cc.type=u.type" if by_type else ""),
    }


def sql_pj(v: str) -> str:
    return f"coalesce(CAST(i_{v} AS DOUBLE)/nullif(n_up+d_{v}-i_{v},0), 0.0)"


def sql_vj(a: str, b: str) -> str:
    a, b = sorted((a, b))
    return f"coalesce(CAST(x_{a}_{b} AS DOUBLE)/nullif(d_{a}+d_{b}-x_{a}_{b},0), 0.0)"


def sql_scores(held: str) -> dict[str, str]:
    a, b = S.others(held)
    return {
        "plan_guided": f"({sql_pj(a)}+{sql_pj(b)})/2.0", "fact_consistency": sql_vj(a, b),
        "single_first": sql_pj(a), "single_second": sql_pj(b),
        "plan_text": f"(p_{a}+p_{b})/2.0", "transcript": f"t_{a}_{b}",
        "fact_consistency_length": f"{sql_vj(a, b)} - CAST(0.5 AS DOUBLE)*length_penalty",
    }


def sql_folds(methods: list[str], keys: str = "model, item_id", source: str = "cands") -> dict[str, str]:
    """folds: one row per candidate and fold; picks: one row per item and fold."""
    parts = []
    for held in VIEWS:
        sc = sql_scores(held)
        cols = ", ".join(f"CAST(round(({sc[m]})*1e12) AS BIGINT) AS {m}" for m in methods)
        parts.append(f"SELECT {keys}, cand_idx, n_up, '{held}' AS evaluator, i_{held} AS kept, {cols} FROM {source}")
    best = ", ".join(
        f"arg_max(cand_idx, ({m}, -cand_idx)) AS {m}_pick, arg_max(kept, ({m}, -cand_idx)) AS {m}_kept, max({m}) AS {m}_s" for m in methods)
    out = ", ".join(
        f"CAST({m}_pick AS BIGINT) AS {m}_pick, {m}_kept, {m}_s/1e12 AS {m}_score, 1.0-CAST({m}_kept AS DOUBLE)/n_up AS {m}_gap" for m in methods)
    return {
        "folds": " UNION ALL ".join(parts),
        "best": f"""SELECT {keys}, evaluator, count(*) AS n_candidates, max(n_up) AS n_up, arg_min(kept, cand_idx) AS base_kept,
 sum(kept) AS sum_kept, arg_max(cand_idx, (kept, -cand_idx)) AS oracle_pick, max(kept) AS oracle_kept, {best} FROM folds GROUP BY {keys}, evaluator""",
        "picks": f"""SELECT {keys}, evaluator, n_candidates, n_up, base_kept, 1.0-CAST(base_kept AS DOUBLE)/n_up AS base_gap,
 1.0-CAST(sum_kept AS DOUBLE)/(CAST(n_up AS DOUBLE)*n_candidates) AS random_gap, CAST(oracle_pick AS BIGINT) AS oracle_pick, oracle_kept,
 1.0-CAST(oracle_kept AS DOUBLE)/n_up AS oracle_gap, {out} FROM best""",
    }


def pools(spark, sf, by_type=False):
    return S.candidate_pools(X.marked_facts(spark, sf), X.candidate_grid(spark, sf), by_type=by_type, pool=X.N_CANDIDATES)


def counts(spark, sf, by_type=False):
    return S.pool_rows(pools(spark, sf, by_type))


FXC = ("fx_plan", "fx_candidates", "fx_grid")
PICK_COLS = ["model", "item_id", "evaluator", "n_candidates", "n_up", "base_gap", "random_gap", "oracle_pick", "oracle_gap"]


@query("w02_leave_one_out", with_fx(*FXC, extra={**sql_counts(), **sql_folds(["plan_guided"])})
       + f"SELECT {', '.join(PICK_COLS)}, plan_guided_pick, plan_guided_gap, round(plan_guided_score,6) AS plan_guided_score FROM picks")
def w02(spark, sf):
    p = S.select_folds(pools(spark, sf), ("plan_guided",))
    return p.select(*PICK_COLS, "plan_guided_pick", "plan_guided_gap", r6(F.col("plan_guided_score")).alias("plan_guided_score"))


SUMMARY = """count(*) AS n_items, max(n_candidates) AS n_candidates, round(avg(base_gap),6) AS loss_original, round(avg(random_gap),6) AS loss_random,
 round(avg({m}_gap),6) AS loss_selected, round(avg(oracle_gap),6) AS loss_oracle, round(avg(base_gap-{m}_gap),6) AS reduction,
 round(avg(CASE WHEN {m}_pick=0 THEN 1.0 ELSE 0.0 END),6) AS picked_original_rate"""
SUM_COLS = ["loss_original", "loss_random", "loss_selected", "loss_oracle", "reduction", "picked_original_rate"]


def rounded(df, names):
    return df.select(*[r6(F.col(c)).alias(c) if c in names else c for c in df.columns])


@query("w05_budget_curve", with_fx(*FXC, extra={**sql_counts(),
       "bc": "SELECT c.*, b.budget FROM cands c JOIN (VALUES (1),(2),(4),(8)) b(budget) ON c.cand_idx < b.budget",
       **sql_folds(["plan_guided"], "model, item_id, budget", "bc")})
       + f"SELECT model, budget, evaluator, {SUMMARY.format(m='plan_guided')} FROM picks GROUP BY model, budget, evaluator")
def w05(spark, sf):
    return rounded(S.fold_summary(S.budget_curve(pools(spark, sf)), ["model", "budget"]), SUM_COLS)


@query("w10_fixed_pair", with_fx(*FXC, extra={**sql_counts(),
       "s": f"SELECT *, CAST(round({sql_pj('asr1')}*1e12) AS BIGINT) AS sc FROM cands",
       "b": """SELECT model, item_id, count(*) AS n, max(n_up) AS n_up, arg_min(i_asr2, cand_idx) AS base, sum(i_asr2) AS total, max(i_asr2) AS orc,
 arg_max(i_asr2, (sc, -cand_idx)) AS kept, arg_max(cand_idx, (sc, -cand_idx)) AS pick FROM s GROUP BY ALL"""})
       + """SELECT model, count(*) AS n_items, round(avg(1.0-CAST(base AS DOUBLE)/n_up),6) AS loss_original, round(avg(1.0-CAST(total AS DOUBLE)/(n_up*n)),6) AS loss_random,
 round(avg(1.0-CAST(kept AS DOUBLE)/n_up),6) AS loss_selected, round(avg(1.0-CAST(orc AS DOUBLE)/n_up),6) AS loss_oracle,
 CAST(count(*) FILTER (1.0-CAST(base AS DOUBLE)/n_up <= 0.001) AS DOUBLE)/count(*) AS perfect_original, CAST(count(*) FILTER (1.0-CAST(kept AS DOUBLE)/n_up <= 0.001) AS DOUBLE)/count(*) AS perfect_selected,
 CAST(count(*) FILTER (pick=0) AS DOUBLE)/count(*) AS picked_original_rate FROM b GROUP BY model""")
def w10(spark, sf):
    p = S.fixed_pair(counts(spark, sf))
    n = F.count(F.lit(1))
    share = lambda c: M.ratio(P._count(c), n)
    return p.groupBy("model").agg(
        n.alias("n_items"), r6(F.avg("base_gap")).alias("loss_original"), r6(F.avg("random_gap")).alias("loss_random"),
        r6(F.avg("selected_gap")).alias("loss_selected"), r6(F.avg("oracle_gap")).alias("loss_oracle"),
        share(F.col("base_gap") <= 0.001).alias("perfect_original"), share(F.col("selected_gap") <= 0.001).alias("perfect_selected"),
        share(F.col("pick") == 0).alias("picked_original_rate"))


BUDGET_METHODS = ["plan_guided", "single_first", "single_second"]
BUDGET_CTE = {**sql_counts(), **sql_folds(BUDGET_METHODS),
    "sb": """SELECT *, (single_first_gap+single_second_gap)/2.0 AS single_loss, single_first_kept+single_second_kept-2*plan_guided_kept AS delta_kept FROM picks"""}


@query("w11_selector_budget", with_fx(*FXC, extra=BUDGET_CTE) + """SELECT model, item_id, evaluator, n_up, single_first_pick, single_second_pick,
 plan_guided_pick AS dual_pick, round(single_loss,6) AS single_loss, plan_guided_gap AS dual_loss, delta_kept FROM sb""")
def w11(spark, sf):
    b = S.selector_budget(S.select_folds(pools(spark, sf), ("plan_guided", "single")))
    return b.select("model", "item_id", "evaluator", "n_up", "single_first_pick", "single_second_pick", "dual_pick",
                    r6(F.col("single_loss")).alias("single_loss"), "dual_loss", "delta_kept")


@query("w11_budget_report", with_fx(*FXC, extra=BUDGET_CTE) + """SELECT model, count(*) AS n_folds, count(DISTINCT item_id) AS n_items, round(avg(single_loss),6) AS single_loss,
 round(avg(plan_guided_gap),6) AS dual_loss, round(avg(single_loss-plan_guided_gap),6) AS single_minus_dual FROM sb GROUP BY model""")
def w11r(spark, sf):
    b = S.selector_budget(S.select_folds(pools(spark, sf), ("plan_guided", "single")))
    per_item = b.groupBy(*ITEM).agg(
        F.count(F.lit(1)).alias("k"), F.sum("single_loss").alias("s"), F.sum("dual_loss").alias("d"), F.sum("single_minus_dual").alias("g"))
    k = F.sum("k")
    return per_item.groupBy("model").agg(
        k.alias("n_folds"), F.count(F.lit(1)).alias("n_items"), r6(F.sum("s") / k).alias("single_loss"),
        r6(F.sum("d") / k).alias("dual_loss"), r6(F.sum("g") / k).alias("single_minus_dual"))


@query("w12_restore_scores", with_fx(*FXC, extra={**sql_counts(),
       "d": "SELECT model, item_id, cand_idx, " + ", ".join(
           f"({sql_pj(S.others(v)[0])}+{sql_pj(S.others(v)[1])})/2.0 AS d_{v}" for v in VIEWS) + ", "
       + ", ".join(f"{sql_pj(v)} AS s_{v}" for v in VIEWS) + " FROM cands"})
       + "SELECT model, item_id, cand_idx, " + ", ".join(f"round(s_{v},6) AS s_{v}" for v in VIEWS) + " FROM d")
def w12(spark, sf):
    means = counts(spark, sf).select(*S.CAND, *[
        ((S.plan_jaccard(S.others(v)[0]) + S.plan_jaccard(S.others(v)[1])) / 2.0).alias(f"d_{v}") for v in VIEWS])
    return S.restore_single_scores(means).select(*S.CAND, *[r6(F.col(f"s_{v}")).alias(f"s_{v}") for v in VIEWS])


# ---- resampling ----------------------------------------------------------------------------

def sql_fifth(source: str, x: str, out: str, p: str = "2147483647") -> str:
    """``out`` = x^5 modulo p beside the columns of the source."""
    return (f"SELECT * EXCLUDE (x2, x4), x4 * {x} % {p} AS {out} FROM (SELECT *, x2 * x2 % {p} AS x4 FROM (SELECT *, {x} * {x} % {p} AS x2 FROM ({source})))")


def sql_keys(sizes: str, group: str, replicates: int, seed: int) -> dict[str, str]:
    """A key of every replicate of every group; ``sizes`` holds (group, size)."""
    h = HASH.format(f"concat_ws(':', {seed}, {group})")
    return {"kb": sql_fifth(f"SELECT *, ({h} % 2147483647 + b * 40692) % 2147483647 AS u FROM {sizes} CROSS JOIN (SELECT unnest(range({replicates})) AS b)", "u", "kb")}


def sql_slots(items: str, group: str, stats: list[str], replicates: int, seed: int, tag: str = "") -> dict[str, str]:
    """Positions of the items in the order of their numbers, and the drawn items of every replicate."""
    first = sql_fifth("SELECT *, (kb + slot * 16807) % 2147483647 AS w FROM (SELECT * EXCLUDE (u), unnest(range(size)) AS slot FROM kb" + tag + ")", "w", "x1")
    second = sql_fifth(f"SELECT * EXCLUDE (w), (x1 * 48271 + kb) % 2147483647 AS w FROM ({first})", "w", "y1")
    return {
        "pos" + tag: f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {', '.join(stats)}) - 1 AS pos FROM {items}",
        "sz" + tag: f"SELECT {group}, count(*) AS size FROM {items} GROUP BY {group}",
        "kb" + tag: sql_keys("sz" + tag, group, replicates, seed)["kb"],
        "drawn" + tag: f"SELECT s.{group.replace(', ', ', s.')}, s.b, " + ", ".join(f"p.{x}" for x in stats)
        + f" FROM (SELECT {group}, b, (x1 * 2147483647 + y1) % size AS pos FROM ({second})) s JOIN pos{tag} p ON p.pos=s.pos AND "
        + " AND ".join(f"p.{g}=s.{g}" for g in group.split(", ")),
    }


def sql_joint(items: str, group: str, ratios: dict[str, tuple[str, str | None]], replicates: int, seed: int, *, rule: str = "linear",
              tag: str = "", stratum: str | None = None, weight: str | None = None) -> dict[str, str]:
    """jci<tag>: interval, point estimate and number of items of many statistics of the same draws."""
    stats = sorted({c for pair in ratios.values() for c in pair if c})
    keys = f"{group}, {stratum}" if stratum else group
    known = f"SELECT {keys}, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in stats) + f" FROM {items}"
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in stats)
    x = lambda a, b: f"CAST({a} AS DOUBLE) / nullif(CAST({b or 'n_items'} AS DOUBLE), 0)"
    value, every = {k: x(a, b) for k, (a, b) in ratios.items()}, f"every{tag}"
    parts = {f"ji{tag}": known, **sql_slots(f"ji{tag}", keys, stats, replicates, seed, tag),
             f"every{tag}": f"SELECT {keys}, b, {sums}, count(*) AS n_items FROM drawn{tag} GROUP BY {keys}, b UNION ALL SELECT {keys}, -1, {sums}, count(*) FROM ji{tag} GROUP BY {keys}"}
    if stratum:
        mean = ", ".join(f"sum({v} * {weight}) / sum({weight}) FILTER ({v} IS NOT NULL) AS v_{k}" for k, v in value.items())
        every, value = f"strata{tag}", {k: f"v_{k}" for k in value}
        parts[every] = f"SELECT {group}, b, CAST(sum(n_items) AS BIGINT) AS n_items, {mean} FROM every{tag} JOIN (SELECT DISTINCT {keys}, {weight} FROM {items}) USING ({keys}) GROUP BY {group}, b"
    parts[f"long{tag}"] = " UNION ALL ".join(f"SELECT {group}, b, n_items, '{k}' AS statistic, {v} AS x FROM {every}" for k, v in value.items())
    parts[f"draws{tag}"] = f"SELECT * FROM long{tag} WHERE b >= 0 AND x IS NOT NULL"
    ci = {"linear": LINEAR, "nearest": NEAREST}[rule].format(g=f"{group}, statistic").replace("FROM draws", f"FROM draws{tag}")
    parts[f"jl{tag}"] = ci
    parts[f"jci{tag}"] = (f"SELECT p.*, ci_lo, ci_hi, n_boot, round(ci_lo, 12) > 0 OR round(ci_hi, 12) < 0 AS excludes_zero FROM "
                          f"(SELECT {group}, statistic, n_items, x AS mean FROM long{tag} WHERE b = -1) p LEFT JOIN jl{tag} USING ({group}, statistic)")
    return parts


def sql_paired(rows: str, group: str, unit: str, fold: str, folds: list[str], values: dict[str, str], replicates: int, seed: int, *,
               sparse: tuple = (), rule: str = "linear", tag: str = "") -> dict[str, str]:
    """pci<tag>: (group, fold, statistic, mean, interval), the twin of ``paired_intervals``."""
    columns, ratios = [], {}
    for i, f in enumerate(folds):
        columns.append(f"count(*) FILTER ({fold} = '{f}')::DOUBLE AS n{i}")
        for name, x in values.items():
            columns.append(f"max({x}) FILTER ({fold} = '{f}') AS {name}{i}")
            if name in sparse:
                columns.append(f"count({x}) FILTER ({fold} = '{f}')::DOUBLE AS n_{name}{i}")
            ratios[f"{name}:{f}"] = (f"{name}{i}", f"n_{name}{i}" if name in sparse else f"n{i}")
    return {f"wide{tag}": f"SELECT {group}, {unit}, {', '.join(columns)} FROM {rows} GROUP BY {group}, {unit}",
            **sql_joint(f"wide{tag}", group, ratios, replicates, seed, rule=rule, tag=tag),
            f"pci{tag}": f"SELECT {group}, split_part(statistic, ':', 2) AS {fold}, split_part(statistic, ':', 1) AS statistic, mean, ci_lo, ci_hi, n_boot, excludes_zero FROM jci{tag} WHERE mean IS NOT NULL"}


def sql_wide(names: list[str]) -> str:
    """Interval columns per statistic, rounded as the reports are."""
    r = {"ci_lo": "round({}, 6)", "ci_hi": "round({}, 6)", "excludes_zero": "{}"}
    return ", ".join(r[c].format(f"max({c}) FILTER (statistic = '{k}')") + f" AS {k}_{c}" for k in names for c in r)


def wide(intervals, group, names):
    """``wide_intervals`` rounded as the reports are."""
    w = B.wide_intervals(intervals, group, names)
    return rounded(w, [c for c in w.columns if c.endswith(("_ci_lo", "_ci_hi"))])


NEAREST = """SELECT {g}, max(x) FILTER (i = lo) AS ci_lo, max(x) FILTER (i = hi) AS ci_hi, max(n) AS n_boot FROM (
 SELECT *, CAST(floor(n*0.025) AS BIGINT) AS lo, CAST(floor(n*0.975) AS BIGINT)-1 AS hi FROM (
 SELECT {g}, x, row_number() OVER (PARTITION BY {g} ORDER BY x)-1 AS i, count(*) OVER (PARTITION BY {g}) AS n FROM draws WHERE x IS NOT NULL)) GROUP BY {g}"""
GAPDIFF = "(1.0-CAST(sum(ra) AS DOUBLE)/nullif(CAST(sum(ta) AS DOUBLE),0)) - (1.0-CAST(sum(rb) AS DOUBLE)/nullif(CAST(sum(tb) AS DOUBLE),0))"
B1 = 10_000


def _hard_vs_content(spark, sf):
    pairs = [p for p in headline_pairs() if p.name in ("speech_hard", "speech_content")]
    c = P.item_counts(presence(spark, sf), pairs, observed(spark, sf))
    zero = F.lit(0).cast("bigint")
    one = lambda m, c_: F.sum(F.when(F.col("metric") == m, F.col(c_)).otherwise(zero))
    return c.groupBy(*ITEM).agg(
        one("speech_hard", "retained").alias("ra"), one("speech_hard", "total").alias("ta"),
        one("speech_content", "retained").alias("rb"), one("speech_content", "total").alias("tb"))


@query("b01_bootstrap_exact", CONTRAST_SQL + ", one AS (SELECT * FROM citems WHERE contrast='forced_minus_speech'), "
       + ", ".join(f"{k} AS ({v})" for k, v in sql_slots("one", "model", ["ra", "ta", "rb", "tb"], B1, 7).items())
       + f", draws AS (SELECT model, b, {GAPDIFF} AS x FROM drawn GROUP BY model, b), ci AS ({NEAREST.format(g='model')}),"
       + f" pt AS (SELECT model, count(*) AS n_items, {GAPDIFF} AS diff FROM one GROUP BY model)"
       + " SELECT model, n_items, diff, ci_lo, ci_hi, n_boot, ci_lo > 0 OR ci_hi < 0 AS excludes_zero FROM pt JOIN ci USING (model)")
def b01(spark, sf):
    items = M.contrast_items(P.presence(X.facts(spark, sf, by_item=True)), observed(spark, sf), {"forced_minus_speech": M.CONTRASTS["forced_minus_speech"]})
    return B.bootstrap_gap_difference(items, ["model"], replicates=B1, seed=7, method="slots")


@query("b01_bootstrap_contrasts")
def b01c(spark, sf):
    items = M.contrast_items(presence(spark, sf), observed(spark, sf), M.CONTRASTS)
    return B.bootstrap_gap_difference(items, ["model", "contrast"], replicates=10_000, method="multinomial")


@query("b01_hard_minus_content")
def b01h(spark, sf):
    return B.bootstrap_gap_difference(_hard_vs_content(spark, sf), ["model"], replicates=10_000, method="multinomial")


GAIN_CTE = {**sql_counts(), **sql_folds(["plan_guided"]),
            "gains": "SELECT model, evaluator, item_id, n_up, CAST(plan_guided_kept - base_kept AS BIGINT) AS k, CAST(plan_guided_kept - base_kept AS DOUBLE)/n_up AS x FROM picks"}


def gains(spark, sf):
    p = S.select_folds(pools(spark, sf))
    return p.select("model", "evaluator", "item_id", "n_up", (F.col("plan_guided_kept") - F.col("base_kept")).alias("k"))


OUTCOMES = """count(*) AS n_items, round(avg(x),6) AS mean, count(*) FILTER (x > 1e-12) AS improved,
 count(*) FILTER (abs(x) <= 1e-12) AS unchanged, count(*) FILTER (x < -1e-12) AS worsened"""
MEAN_COLS = ["mean", "ci_lo", "ci_hi"]


def _mean_sql(rule: str) -> str:
    g = "model, evaluator"
    return (with_fx(*FXC, extra={**GAIN_CTE, **sql_paired("gains", "model", "item_id", "evaluator", list(VIEWS), {"gain": "x"}, B1, 11, rule=rule),
            "pt": f"SELECT {g}, {OUTCOMES} FROM gains GROUP BY {g}"})
            + "SELECT pt.*, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi, n_boot, excludes_zero FROM pt JOIN pci USING (model, evaluator)")


LINEAR = "SELECT {g}, quantile_cont(x, 0.025) AS ci_lo, quantile_cont(x, 0.975) AS ci_hi, count(*) AS n_boot FROM draws GROUP BY {g}"


def _means(spark, sf, rule):
    g, x = materialise(gains(spark, sf)), F.col("k").cast("double") / F.col("n_up").cast("double")
    ci = B.paired_intervals(g, ["model"], ["item_id"], "evaluator", VIEWS, {"gain": x}, replicates=B1, seed=11, rule=rule).drop("statistic")
    return rounded(B.outcomes(g, ["model", "evaluator"], x).join(ci, ["model", "evaluator"]), MEAN_COLS)


@query("b02_bootstrap_mean", _mean_sql("nearest"))
def b02(spark, sf):
    return _means(spark, sf, "nearest")


@query("b03_bootstrap_linear", _mean_sql("linear"))
def b03(spark, sf):
    return _means(spark, sf, "linear")


@query("b03_reduction_intervals")
def b03m(spark, sf):
    return rounded(B.bootstrap_mean(gains(spark, sf), ["model", "evaluator"], "k", "n_up", method="multinomial", rule="linear"), MEAN_COLS)


@query("w04_fold_summary", with_fx(*FXC, extra={**sql_counts(), **sql_folds(["plan_guided"]),
       **sql_paired("picks", "model", "item_id", "evaluator", list(VIEWS), {"reduction": "base_gap - plan_guided_gap"}, B1, 13, rule="nearest"),
       "sm": f"SELECT model, evaluator, {SUMMARY.format(m='plan_guided')} FROM picks GROUP BY model, evaluator",
       "ci": f"SELECT model, evaluator, {sql_wide(['reduction'])} FROM pci GROUP BY model, evaluator"})
       + "SELECT * FROM sm JOIN ci USING (model, evaluator)")
def w04(spark, sf):
    picks = materialise(S.select_folds(pools(spark, sf)))
    ci = B.paired_intervals(picks, ["model"], ["item_id"], "evaluator", VIEWS, {"reduction": F.col("base_gap") - F.col("plan_guided_gap")},
                            replicates=B1, seed=13, rule="nearest")
    return rounded(S.fold_summary(picks, ["model"]), SUM_COLS).join(wide(ci, ["model", "evaluator"], ["reduction"]), ["model", "evaluator"])


# Facts that never or always survive, with a relative position in thousandths.
POSITIONS = """SELECT model, type || item_id || '-' || value AS rid, survival = 0 AS never, (item_id * 131 + CAST(value AS BIGINT) * 17) % 1000 AS pos
 FROM alive WHERE survival = 0 OR survival = 8"""


def positions(spark, sf):
    from factrail.plans.catalog_paths import alive

    pos = (F.col("item_id") * 131 + F.col("value").cast("bigint") * 17) % 1000
    return alive(spark, sf).where("survival = 0 OR survival = 8").select(
        "model", F.concat("type", F.col("item_id").cast("string"), F.lit("-"), "value").alias("rid"),
        (F.col("survival") == 0).alias("never"), pos.alias("pos"))


def _permuted(source: str) -> str:
    """y: the image of x under the keyed permutation of the residues of p."""
    inner = sql_fifth(f"SELECT *, (x * a1 + c1) % p AS u FROM {source}", "u", "v", "p")
    return sql_fifth(f"SELECT *, (v * a2 + c2) % p AS w FROM ({inner})", "w", "y", "p")


def _permutation_sql() -> str:
    from factrail.plans.catalog_paths import ALIVE

    diff = "CAST({a} AS DOUBLE)/n_a - CAST(s-{a} AS DOUBLE)/n_b"
    return with_fx("fx_plan", "fx_candidates", recursive=True, extra={**ALIVE, "rows_": POSITIONS,
        "sz": "SELECT model, count(*) AS size, count(*) FILTER (never) AS n_a, count(*) FILTER (NOT never) AS n_b, sum(pos) AS s, sum(pos) FILTER (never) AS s_a FROM rows_ GROUP BY model",
        "prime": "SELECT model, min(p) AS p FROM (SELECT model, unnest(range(size, size + 1000)) AS p FROM sz) WHERE p % 5 <> 1 AND len(list_filter(range(2, CAST(sqrt(p) AS BIGINT) + 1), lambda d: p % d = 0)) = 0 GROUP BY model",
        **sql_keys("(SELECT model, size, least(n_a, n_b) AS k FROM sz)", "model", B1, 3),
        "keyed": "SELECT model, b, size, k, p, kb % (p - 1) + 1 AS a1, kb * 48271 % 2147483647 % p AS c1, kb * 69621 % 2147483647 % (p - 1) + 1 AS a2, kb * 40692 % 2147483647 % p AS c2 FROM kb JOIN prime USING (model)",
        "img": "SELECT model, b, size, p, a1, c1, a2, c2, y FROM (" + _permuted("(SELECT *, unnest(range(k)) AS x FROM keyed)") + ")",
        "walk": "SELECT * FROM img WHERE y >= size UNION ALL SELECT model, b, size, p, a1, c1, a2, c2, y FROM (" + _permuted("(SELECT * RENAME (y AS x) FROM walk WHERE y >= size)") + ")",
        "line": "SELECT model, pos AS v, row_number() OVER (PARTITION BY model ORDER BY pos) - 1 AS y FROM rows_",
        "got": "SELECT model, b, y FROM img WHERE y < size UNION ALL SELECT model, b, y FROM walk WHERE y < size",
        "st": "SELECT g.model, b, CASE WHEN max(n_a) <= max(n_b) THEN sum(v) ELSE max(s) - sum(v) END AS a FROM got g JOIN line l ON l.model = g.model AND l.y = g.y JOIN sz ON sz.model = g.model GROUP BY g.model, b",
        "hit": f"SELECT st.model, count(*) FILTER (abs({diff.format(a='a')}) >= abs({diff.format(a='s_a')}) - 1e-15) AS hits FROM st JOIN sz USING (model) GROUP BY st.model"}
    ) + f"SELECT model, n_a, n_b, {diff.format(a='s_a')} AS diff, CASE WHEN n_a>=2 AND n_b>=2 THEN CAST(hits+1 AS DOUBLE)/{B1 + 1} END AS p_value FROM sz JOIN hit USING (model)"


@query("b04_permutation_exact", _permutation_sql())
def b04(spark, sf):
    return B.permutation_test_ordered(positions(spark, sf), ["model"], "never", "pos", "rid", replicates=B1, seed=3)


@query("b04_permutation_counts")
def b04c(spark, sf):
    return B.permutation_test(positions(spark, sf), ["model"], "never", "pos")


@query("b05_seed_manifest", with_fx("fx_items") + """SELECT item_id, model, cand_idx, seed FROM fx_items
 CROSS JOIN (VALUES (7, CAST(11 AS BIGINT)), (8, CAST(12 AS BIGINT)), (9, CAST(13 AS BIGINT))) t(cand_idx, seed)""")
def b05(spark, sf):
    return B.seed_manifest(X.items(spark, sf), "11, 12, 13, 14", 3, candidate_offset=7)
