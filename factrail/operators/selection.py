"""Candidate selection under leave-one-view-out evaluation.

A struct per candidate carries every count that any selector needs: facts of the plan, of each view, and of their
intersections; an item's candidates are one array. Methods, folds and budgets are then arithmetic on that struct and one
maximum of the array; no window sorts a pool and no pair of candidates is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factrail.dims import FACT_TYPES, VIEWS
from factrail.functions.batches import compared
from factrail.functions.stats import ratio
from factrail.operators.pairing import FACT_KEY, ITEM, _count
from factrail.session import parallelism

CAND = (*ITEM, "cand_idx")
BITS = {"asr1": 1, "asr2": 2, "asr3": 4}
#: Candidates in a word of the bit layout, three bits each, and candidates that are counted on one row.
WORD, BLOCK = 16, 8
SCALE = 1_000_000_000_000
#: Every count of a candidate: the word whose bits it looks at (all facts or the plan's) and the views that must hold a fact.
COUNTS = {
    **{f"d_{v}": ("_b", b) for v, b in BITS.items()}, **{f"i_{v}": ("_i", b) for v, b in BITS.items()},
    **{f"x_{a}_{b}": ("_b", BITS[a] | BITS[b]) for k, a in enumerate(VIEWS) for b in VIEWS[k + 1:]}}


def marked_facts(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item, fact, cand_idx, view): the facts of candidates, and those of the plan as view ``plan`` of candidate -1."""
    return candidates.select(*ITEM, *FACT_KEY, "cand_idx", "view").unionByName(
        plan.select(*ITEM, *FACT_KEY, F.lit(-1).alias("cand_idx"), F.lit("plan").alias("view")))


def candidate_counts(
    plan: DataFrame, candidates: DataFrame, grid: DataFrame, *, by_type: bool = False, pool: int | None = None
) -> DataFrame:
    """(item, cand_idx, [type], n_up, d_v, i_v, x_vw): one row for every candidate of ``candidate_pools``."""
    return pool_rows(candidate_pools(marked_facts(plan, candidates), grid, by_type=by_type, pool=pool))


def pool_rows(pools: DataFrame) -> DataFrame:
    """One row per candidate of every pool."""
    kind = ["type"] if "type" in pools.columns else []
    return pools.select(*ITEM, *kind, "n_up", F.explode("pool").alias("c")).select(
        *ITEM, "c.cand_idx", *kind, "n_up", *[f"c.{n}" for n in COUNTS])


def candidate_pools(marked: DataFrame, grid: DataFrame, *, by_type: bool = False, pool: int | None = None) -> DataFrame:
    """(item, [type], n_up, pool): an array of a struct (cand_idx, d_v, i_v, x_vw) for every candidate of an item.

    ``marked`` holds the rows of ``marked_facts``; ``grid`` lists every (item, candidate) once, also those without a fact.
    d is the size of a view, i its intersection with the plan, x the intersection of two views. Plans without facts are not
    eligible and leave no row. ``pool`` is the least number above all candidate indices; it is read off the grid where
    it is not given, and an index beyond it is an error.

    A fact of an item travels once, with three bits for every candidate and a mark of the plan, and then without its text
    to the item's partition. Counts are sums on one row for every BLOCK candidates, so a fact is not repeated per
    candidate and no candidate rows are sorted or joined.
    """
    spark, kind = marked.sparkSession, ["type"] if by_type else []
    if pool is None:
        pool = (grid.agg(F.max("cand_idx")).first()[0] or 0) + 1
    starts, blocks = range(0, pool, WORD), range(0, pool, BLOCK)
    words, places = [f"_w{k}" for k in range(len(starts))], [f"_g{k}" for k in range(len(starts))]
    bit = "CASE " + " ".join(f"WHEN view = '{v}' THEN {b}L" for v, b in BITS.items()) + " ELSE 0L END"
    nothing = F.lit(0).cast("bigint")

    def layout(bits: str, names: Sequence[str]) -> list[Column]:
        """The bits at the candidate's place, one word for every WORD candidates."""
        return [F.when(F.col("cand_idx").between(at, at + WORD - 1), F.expr(f"shiftleft({bits}, 3 * CAST(cand_idx - {at} AS INT))"))
                .otherwise(nothing).alias(w) for at, w in zip(starts, names)]

    def in_block(names: Sequence[str]) -> Column:
        """The bits of a block's candidates."""
        bits = F.lit(None).cast("bigint")
        for k, at in enumerate(blocks):
            bits = F.when(F.col("_block") == k, F.expr(f"shiftright({names[at // WORD]}, {3 * (at % WORD)}) & {(1 << 3 * BLOCK) - 1}L")).otherwise(bits)
        return bits

    held = marked.select(*ITEM, *FACT_KEY, *layout(bit, words), (F.col("view") == "plan").cast("int").alias("_p")).groupBy(*ITEM, *FACT_KEY).agg(
        *[F.bit_or(w).alias(w) for w in words], F.max("_p").alias("_p"))
    known, keyed = F.lit(True), F.lit(True)
    for k in FACT_KEY:
        known = known & F.col(k).isNotNull()
    for k in ITEM:
        keyed = keyed & F.col(k).isNotNull()
    thin = held.where(keyed).select(*ITEM, *kind, *words, "_p", known.alias("_known"))
    outside = (F.col("cand_idx") < 0) | (F.col("cand_idx") >= pool)
    checked = grid.where(keyed).select(*ITEM, F.when(outside, F.raise_error(F.lit("a candidate index lies outside the pool")).cast("int")).otherwise(
        F.col("cand_idx")).alias("cand_idx"))
    listed = checked.select(*ITEM, *layout("1L", places)).groupBy(*ITEM).agg(*[F.bit_or(g).alias(g) for g in places])
    n = parallelism(spark)
    if by_type:  # every type of an item needs the item's candidates
        rows = thin.repartition(n, *ITEM).join(listed, list(ITEM))
    else:
        rows = thin.select("*", *[nothing.alias(g) for g in places]).unionByName(
            listed.select("*", *[nothing.alias(w) for w in words], F.lit(0).alias("_p"), F.lit(False).alias("_known"))).repartition(n, *ITEM)
    if len(blocks) > 1:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))).alias("_block"))
    else:
        rows = rows.withColumn("_block", F.lit(0))
    bits = in_block(words)
    rows = rows.select(*ITEM, *kind, "_block", "_p", bits.alias("_b"), F.when((F.col("_p") == 1) & F.col("_known"), bits).otherwise(nothing).alias("_i"), in_block(places).alias("_g"))
    has = lambda word, mask: F.count(F.expr(f"CASE WHEN ({word} & {mask}L) = {mask}L THEN 1 END"))
    sums = [(f"{name}_{c}", has(word, mask << 3 * c)) for c in range(min(BLOCK, pool)) for name, (word, mask) in COUNTS.items()]
    keys = [*ITEM, *kind, "_block"]
    wide = rows.groupBy(*keys).agg(F.sum(F.col("_p").cast("bigint")).alias("n_up"), F.bit_or("_g").alias("_g"), *[x.alias(name) for name, x in sums])
    index = lambda c: (F.col("_block") * BLOCK + c).cast(grid.schema["cand_idx"].dataType)
    every = F.array(*[F.when(F.expr(f"(_g & {1 << 3 * c}L) <> 0L"), F.struct(index(c).alias("cand_idx"), *[F.col(f"{name}_{c}").alias(name) for name in COUNTS]))
                      for c in range(min(BLOCK, pool))])
    pools = wide.where("n_up > 0").select(*ITEM, *kind, "n_up", F.array_compact(every).alias("pool"))
    if len(blocks) > 1:
        pools = pools.groupBy(*ITEM, *kind).agg(F.max("n_up").alias("n_up"), F.flatten(F.collect_list("pool")).alias("pool"))
    return pools.where(F.size("pool") > 0)


def eligible_items(plan: DataFrame, expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """The items that take part in selection: a plan with facts, as many candidates in every view, at least one, and an
    extraction for each of them.

    plan (item, fact); expected (item, view, key) lists the texts of an item's candidates; extracted (key) those whose
    facts are known. NULL keys are never extracted. One aggregation per item after one join on the key.
    """
    known = extracted.select("key").where("key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    marked = expected.select(*ITEM, "view", "key").join(known, "key", "left")
    each = marked.groupBy(*ITEM).agg(
        *[_count(F.col("view") == v).alias(f"_{v}") for v in VIEWS], F.bool_and(F.col("_known").isNotNull()).alias("_all"))
    even = F.col(f"_{VIEWS[0]}") >= 1
    for v in VIEWS[1:]:
        even = even & (F.col(f"_{v}") == F.col(f"_{VIEWS[0]}"))
    return each.where(even & F.col("_all")).select(*ITEM, F.col(f"_{VIEWS[0]}").alias("n_candidates")).join(
        plan.select(*ITEM).distinct(), list(ITEM), "left_semi")


def view_pairs() -> list[tuple[str, str]]:
    return [(a, b) for k, a in enumerate(VIEWS) for b in VIEWS[k + 1:]]


def plan_jaccard(view: str, col: Callable[[str], Column] = F.col) -> Column:
    """Jaccard of plan and view; an empty union gives 0."""
    i, d, n = col(f"i_{view}"), col(f"d_{view}"), col("n_up")
    return F.coalesce(ratio(i, n + d - i), F.lit(0.0))


def view_jaccard(a: str, b: str, col: Callable[[str], Column] = F.col) -> Column:
    a, b = sorted((a, b))
    x = col(f"x_{a}_{b}")
    return F.coalesce(ratio(x, col(f"d_{a}") + col(f"d_{b}") - x), F.lit(0.0))


def text_scores(texts: DataFrame) -> DataFrame:
    """(item, cand_idx, p_v, t_vw): likeness of the normalised plan text to each view's, and of every two views' raw words.

    texts (item, cand_idx, plan_text, views). Candidates of an item often say the same and lie side by side, so a batch of rows
    normalises each distinct text once and compares each distinct pair once; no shuffle. A NULL text is empty.
    """
    measures = [*[(f"p_{v}", "plan_text", v, "normal") for v in VIEWS], *[(f"t_{a}_{b}", a, b, "raw") for a, b in view_pairs()]]
    return compared(texts, CAND, ("plan_text", *VIEWS), measures)


def loss(view: str) -> Column:
    return F.lit(1.0) - ratio(F.col(f"i_{view}"), F.col("n_up"))


def exact(score: Column) -> Column:
    """Scores as integers of 1e-12, so that equal fractions reached in different ways stay tied."""
    return F.round(score * F.lit(float(SCALE))).cast("bigint")


def others(view: str, views: Sequence[str] = VIEWS) -> list[str]:
    return [v for v in views if v != view]


def fold_scores(held_out: str, methods: Sequence[str], col: Callable[[str], Column] = F.col) -> dict[str, Column]:
    a, b = others(held_out)
    scores = {
        "plan_guided": (plan_jaccard(a, col) + plan_jaccard(b, col)) / 2.0,
        "fact_consistency": view_jaccard(a, b, col),
        f"single_{a}": plan_jaccard(a, col),
        f"single_{b}": plan_jaccard(b, col),
    }
    if "plan_text" in methods:
        scores["plan_text"] = (col(f"p_{a}") + col(f"p_{b}")) / 2.0
    if "transcript" in methods:
        scores["transcript"] = col(f"t_{a}_{b}")
    if "fact_consistency_length" in methods:
        scores["fact_consistency_length"] = view_jaccard(a, b, col) - F.lit(0.5) * col("length_penalty")
    return {m: s for m, s in scores.items() if m in methods or m.startswith("single_") and "single" in methods}


def length_penalty(durations: DataFrame) -> DataFrame:
    """(candidate, length_penalty): how far a known duration exceeds the median of its pool, else 0."""
    median = durations.where(F.col("duration").isNotNull()).groupBy(*ITEM).agg(F.median("duration").alias("mid"))
    d, mid = F.col("duration"), F.col("mid")
    value = F.when(mid.isNull() | d.isNull() | (mid <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (d - mid) / mid))
    return durations.join(median, list(ITEM), "left").select(*CAND, value.alias("length_penalty"))


def select_folds(
    counts: DataFrame,
    methods: Sequence[str] = ("plan_guided",),
    *,
    folds: Sequence[str] = VIEWS,
    keys: Sequence[str] = ITEM,
    budgets: Sequence[int] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (item, held-out view): base, mean, oracle and selected losses and picks.

    ``counts`` has a row per candidate, or per item with its candidates in ``pool``. Losses stay integer pairs (kept facts
    ``i``, plan facts ``n_up``) until the end. Ties go to the earliest candidate. A candidate is scored once for all folds
    and budgets; a budget looks at the first N candidates of a pool (a further column), and one without a candidate leaves
    no row. ``keep`` names columns of the pool that every row carries on.
    """
    pools = counts
    if "pool" not in counts.columns:
        fields = [c for c in counts.columns if c not in (*keys, "n_up")]
        pools = counts.groupBy(*keys).agg(F.max("n_up").alias("n_up"), F.collect_list(F.struct(*fields)).alias("pool"))
    one, n, ranked = F.lit(1.0), F.col("n_up").cast("double"), {}

    def scored(x: Column) -> Column:
        col = lambda name: F.col("n_up") if name == "n_up" else x[name]
        fields = [(-x["cand_idx"]).alias("c"), *[x[f"i_{v}"].alias(f"i_{v}") for v in folds]]
        for held in folds:
            scores = fold_scores(held, methods, col)
            plain, singles = _generic(methods, scores, held)
            ranked[held] = {**{m: scores[m] for m in plain}, **singles}
            fields += [exact(s).alias(f"{m}_{held}") for m, s in ranked[held].items()]
        return F.struct(*fields)

    rows = pools.select(*keys, *keep, "n_up", F.transform("pool", scored).alias("_all"))
    among = {j: f"_all{j}" if budgets else "_all" for j in range(len(budgets) or 1)}
    if budgets:
        rows = rows.select(*keys, *keep, "n_up", *[F.expr(f"filter(_all, x -> x.c > -{b})").alias(among[j]) for j, b in enumerate(budgets)])
    tops, shapes = [], []
    for j, budget in enumerate(budgets or [None]):
        top = lambda *names, a=among[j]: F.array_max(F.transform(a, lambda x: F.struct(*[x[old].alias(new) for old, new in names])))
        tops += [F.size(among[j]).cast("bigint").alias(f"_n{j}"), top(("c", "c"), *[(f"i_{v}", f"i_{v}") for v in folds]).alias(f"_first{j}")]
        for held in folds:
            at, kept = f"{j}_{held}", (f"i_{held}", "kept")
            tops += [F.expr(f"aggregate({among[j]}, 0L, (a, x) -> a + x.i_{held})").alias(f"_sum{at}"), top(kept, ("c", "c")).alias(f"_oracle{at}")]
            tops += [top((f"{m}_{held}", "s"), ("c", "c"), kept).alias(f"_{m}{at}") for m in ranked[held]]
            size, base, best = F.col(f"_n{j}"), F.col(f"_first{j}.i_{held}"), F.col(f"_oracle{at}")
            out = [
                *([] if budget is None else [F.lit(budget).alias("budget")]),
                F.lit(held).alias("evaluator"), size.alias("n_candidates"), F.col("n_up").alias("n_up"), base.alias("base_kept"),
                (one - base / n).alias("base_gap"), (one - F.col(f"_sum{at}") / (n * size)).alias("random_gap"),
                (-best["c"]).cast("bigint").alias("oracle_pick"), best["kept"].alias("oracle_kept"), (one - best["kept"] / n).alias("oracle_gap")]
            for m in ranked[held]:
                t = F.col(f"_{m}{at}")
                out += [(-t["c"]).cast("bigint").alias(f"{m}_pick"), t["kept"].alias(f"{m}_kept"),
                        (t["s"] / F.lit(float(SCALE))).alias(f"{m}_score"), (one - t["kept"] / n).alias(f"{m}_gap")]
            shapes.append(F.struct(*out) if budget is None else F.when(size > 0, F.struct(*out)))
    rows = rows.select(*keys, *keep, "n_up", *tops).select(*keys, *keep, F.explode(F.array(*shapes)).alias("f"))
    return rows.where("f IS NOT NULL").select(*keys, *keep, "f.*") if budgets else rows.select(*keys, *keep, "f.*")


def _generic(methods: Sequence[str], scores: dict[str, Column], held: str) -> tuple[list[str], dict[str, Column]]:
    """Method columns that mean the same in every fold; the two single selectors by position."""
    plain = [m for m in methods if m != "single"]
    singles: dict[str, Column] = {}
    if "single" in methods:
        a, b = others(held)
        singles = {"single_first": scores[f"single_{a}"], "single_second": scores[f"single_{b}"]}
    return plain, singles


def random_pick(pools: DataFrame, *, seed: int = 20260918) -> DataFrame:
    """The picks of ``pools`` with the uniform pick of each fold and its loss: md5(seed, fold, item) mod pool size; a pick that
    no candidate bears leaves no row."""
    from factrail.operators.resampling import hash_number

    chosen = select_folds(pools, keep=["pool"]).withColumn(
        "random_pick",
        F.pmod(hash_number(F.lit(seed), F.col("evaluator"), F.col("item_id")), F.col("n_candidates")),
    ).withColumn("_c", F.filter("pool", lambda x: x["cand_idx"] == F.col("random_pick"))).where(F.size("_c") > 0)
    kept = F.lit(None).cast("bigint")
    for v in VIEWS:
        kept = F.when(F.col("evaluator") == v, F.col("_c")[0][f"i_{v}"]).otherwise(kept)
    return chosen.withColumn("random_pick_kept", kept).withColumn(
        "random_pick_gap", F.lit(1.0) - F.col("random_pick_kept") / F.col("n_up").cast("double")
    ).drop("pool", "_c")


def budget_curve(counts: DataFrame, budgets: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """The first N candidates of every pool, each budget evaluated on its own in one pass."""
    return select_folds(counts, ("plan_guided",), budgets=budgets)


def fold_summary(picks: DataFrame, keys: Sequence[str], method: str = "plan_guided") -> DataFrame:
    return picks.groupBy(*keys, "evaluator").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max("n_candidates").alias("n_candidates"),
        F.avg("base_gap").alias("loss_original"),
        F.avg("random_gap").alias("loss_random"),
        F.avg(f"{method}_gap").alias("loss_selected"),
        F.avg("oracle_gap").alias("loss_oracle"),
        F.avg(F.col("base_gap") - F.col(f"{method}_gap")).alias("reduction"),
        F.avg((F.col(f"{method}_pick") == 0).cast("double")).alias("picked_original_rate"),
    )


def macro(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("reduction").alias("macro_reduction"), F.min("reduction").alias("min_reduction"))


def restore_single_scores(pair_means: DataFrame) -> DataFrame:
    """s_i = d_j + d_k - d_i from the saved mean scores of the two views other than i (columns d_v)."""
    out = []
    for v in VIEWS:
        a, b = others(v)
        out.append(F.round(F.col(f"d_{a}") + F.col(f"d_{b}") - F.col(f"d_{v}"), 9).alias(f"s_{v}"))
    return pair_means.select("*", *out)


def selector_budget(picks: DataFrame) -> DataFrame:
    """Single against dual selectors on one pool; the single loss is the mean of both alternatives."""
    single = (F.col("single_first_gap") + F.col("single_second_gap")) / 2.0
    return picks.select(
        *ITEM, "evaluator", "n_up", "base_gap", "single_first_pick", "single_first_gap", "single_second_pick",
        "single_second_gap", single.alias("single_loss"),
        F.col("plan_guided_pick").alias("dual_pick"), F.col("plan_guided_gap").alias("dual_loss"),
        (single - F.col("plan_guided_gap")).alias("single_minus_dual"),
        (F.col("single_first_kept") + F.col("single_second_kept") - 2 * F.col("plan_guided_kept")).alias("delta_kept"),
    )


def fixed_pair(counts: DataFrame, selector: str = "asr1", evaluator: str = "asr2") -> DataFrame:
    """One fixed selector and evaluator: picks and losses per item, pools of at least two candidates."""
    rows = counts.select(*ITEM, "cand_idx", "n_up", F.col(f"i_{evaluator}").alias("kept"), exact(plan_jaccard(selector)).alias("s"))
    c = (-F.col("cand_idx")).alias("c")
    picked = rows.groupBy(*ITEM).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("n_up").alias("n_up"),
        F.max(F.struct(c, "kept")).getField("kept").alias("base"), F.sum("kept").alias("all_kept"),
        F.max(F.struct("s", c, "kept")).alias("best"), F.max("kept").alias("oracle"),
    ).where("n_candidates >= 2")
    n = F.col("n_up").cast("double")
    return picked.select(
        *ITEM, "n_candidates", "n_up", (-F.col("best.c")).cast("bigint").alias("pick"),
        (1.0 - F.col("base") / n).alias("base_gap"),
        (1.0 - F.col("all_kept") / (n * F.col("n_candidates"))).alias("random_gap"),
        (1.0 - F.col("best.kept") / n).alias("selected_gap"),
        (1.0 - F.col("oracle") / n).alias("oracle_gap"),
    )


METHODS3 = ("original", "plan_text", "plan_fact")


def typed_losses(picks: DataFrame, typed: DataFrame) -> DataFrame:
    """(item, evaluator, type, n_up, loss per method): saved picks judged on each fact type, and overall.

    ``picks`` holds plan_text_pick and plan_guided_pick; ``typed`` is ``candidate_pools(by_type=True)``, or its rows
    (``candidate_counts``). A fold meets the pools of its item, so candidates are looked up in an array and never travel as rows.
    """
    if "pool" not in typed.columns:
        fields = [c for c in typed.columns if c not in (*ITEM, "type", "n_up")]
        typed = typed.groupBy(*ITEM, "type").agg(F.max("n_up").alias("n_up"), F.collect_list(F.struct(*fields)).alias("pool"))
    wanted = picks.select(
        *ITEM, "evaluator", (F.col("plan_text_pick") != F.col("plan_guided_pick")).alias("different"),
        F.lit(0).cast("bigint").alias("_original"), F.col("plan_text_pick").alias("_plan_text"), F.col("plan_guided_pick").alias("_plan_fact"))
    chosen = lambda m: F.get(F.filter("pool", lambda x: x["cand_idx"] == F.col(f"_{m}")), F.lit(0))
    met = wanted.join(typed, list(ITEM)).select(
        *ITEM, "evaluator", "different", "type", "n_up", *[chosen(m).alias(f"_{m}") for m in METHODS3])

    def kept(m: str) -> Column:
        out = F.lit(None).cast("bigint")
        for v in VIEWS:
            out = F.when(F.col("evaluator") == v, F.col(f"_{m}.i_{v}")).otherwise(out)
        return out

    judged = met.where(" OR ".join(f"_{m} IS NOT NULL" for m in METHODS3)).select(
        *ITEM, "evaluator", "different", "type", F.when(F.col("_original").isNotNull(), F.col("n_up")).alias("n_up"), *[kept(m).alias(f"k_{m}") for m in METHODS3])
    sums = ("n_up", *[f"k_{m}" for m in METHODS3])
    per_fold = judged.groupBy(*ITEM, "evaluator").agg(
        F.max("different").alias("different"), F.collect_list(F.struct("type", *sums)).alias("_types"), *[F.sum(c).alias(c) for c in sums])
    both = F.concat("_types", F.array(F.struct(F.lit("overall").alias("type"), *sums)))
    return per_fold.select(*ITEM, "evaluator", "different", F.explode(both).alias("t")).select(
        *ITEM, "evaluator", "t.type", "different", "t.n_up",
        *[(1.0 - F.col(f"t.k_{m}") / F.col("t.n_up").cast("double")).alias(m) for m in METHODS3])


def question_means(losses: DataFrame) -> DataFrame:
    """(item, type): the mean losses over a question's folds, for questions with all three; c_ columns over the folds in
    which the methods picked differently (NULL without one)."""
    different = F.col("different")
    return losses.groupBy(*ITEM, "type").agg(
        F.count_distinct("evaluator").alias("folds"), F.max("n_up").alias("n_up"),
        F.sum(different.cast("bigint")).alias("n_diff"),
        *[F.avg(m).alias(m) for m in METHODS3],
        *[F.avg(F.when(different, F.col(m))).alias(f"c_{m}") for m in METHODS3],
    ).where(F.col("folds") == len(VIEWS))


def question_intervals(losses: DataFrame, types: Sequence[str], **draw) -> DataFrame:
    """(model, type, statistic, mean, interval): paired gains of plan facts over the original and over plan texts, the
    latter also where both picked differently; all types and gains of a model from the same draws of questions."""
    from factrail.operators.resampling import paired_intervals

    difference = lambda a, b: F.round(F.col(a) - F.col(b), 12)  # noqa: E731  (means of folds that are equal but for their last bit are one cell)
    gains = {
        "original_minus_fact": difference("original", "plan_fact"), "text_minus_fact": difference("plan_text", "plan_fact"),
        "conditional_text_minus_fact": difference("c_plan_text", "c_plan_fact")}
    return paired_intervals(question_means(losses), ["model"], ["item_id"], "type", types, gains, sparse=["conditional_text_minus_fact"], **draw)


def question_summary(losses: DataFrame, keys: Sequence[str] = ("model",), tol: float = 1e-12) -> DataFrame:
    """Equal question weights: mean over a question's folds, then over questions; with outcome counts.

    Questions without all three folds are left out (``incomplete_questions`` lists them).
    """
    q = question_means(losses)
    text_gain, orig_gain = F.col("plan_text") - F.col("plan_fact"), F.col("original") - F.col("plan_fact")
    cond_gain = F.col("c_plan_text") - F.col("c_plan_fact")

    def tally(gain: Column, prefix: str) -> list[Column]:
        return [
            _count(gain > tol).alias(f"{prefix}_improved"),
            _count(F.abs(gain) <= tol).alias(f"{prefix}_unchanged"),
            _count(gain < -tol).alias(f"{prefix}_worsened"),
        ]

    return q.groupBy(*keys, "type").agg(
        F.count(F.lit(1)).alias("n_questions"), F.sum("n_up").alias("n_upstream_facts"),
        *[F.avg(m).alias(f"loss_{m}") for m in METHODS3],
        F.avg(orig_gain).alias("original_minus_fact"), F.avg(text_gain).alias("text_minus_fact"),
        *tally(orig_gain, "original"), *tally(text_gain, "text"),
        _count(F.col("n_diff") > 0).alias("n_disagreeing"), F.sum("n_diff").alias("n_disagreeing_folds"),
        F.avg(cond_gain).alias("conditional_text_minus_fact"),
    )


def selection_violations(saved: DataFrame, losses: DataFrame, tol: float = 1e-12) -> DataFrame:
    """(item, evaluator, rule): saved losses that differ, duplicate folds, incomplete questions, odd types."""
    overall = losses.where(F.col("type") == "overall")
    pair = saved.join(overall, [*ITEM, "evaluator"], "left")
    off = F.lit(False)
    for a, b in (("base_gap", "original"), ("plan_text_gap", "plan_text"), ("plan_guided_gap", "plan_fact")):
        off = off | F.coalesce(F.abs(F.col(a) - F.col(b)) > tol, F.lit(True))
    mismatch = pair.where(off).select(*ITEM, "evaluator", F.lit("loss mismatch").alias("rule"))
    twice = saved.groupBy(*ITEM, "evaluator").count().where("count > 1").select(
        *ITEM, "evaluator", F.lit("duplicate fold").alias("rule"))
    partial = saved.groupBy(*ITEM).agg(F.count_distinct("evaluator").alias("k")).where(F.col("k") != len(VIEWS)).select(
        *ITEM, F.lit(None).cast("string").alias("evaluator"), F.lit("incomplete question").alias("rule"))
    odd = losses.where(~F.col("type").isin(*FACT_TYPES, "overall")).select(
        *ITEM, "evaluator", F.lit("unknown fact type").alias("rule")).distinct()
    return mismatch.unionByName(twice).unionByName(partial).unionByName(odd)


def assemble_candidates(base: DataFrame, resamples: DataFrame) -> DataFrame:
    """Candidate corpus: the original reading as candidate 0, then resamples in numeric order.

    Items need a plan text and the first two views; resamples without them are skipped and later
    indices move up (``r_no`` keeps the file number). The third view is kept only where every
    candidate of the item has it. The index is a count of earlier candidates, so it comes from a
    window over one item's pool.
    """
    from pyspark.sql import Window as W

    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    zero = base.where(filled("text") & filled("asr1") & filled("asr2")).select(
        *ITEM, F.col("text").alias("plan_text"), F.lit(-1).cast("bigint").alias("r_no"), *VIEWS)
    more = resamples.where(filled("asr1") & filled("asr2")).join(
        zero.select(*ITEM, "plan_text"), list(ITEM)).select(
        *ITEM, "plan_text", F.col("r_no").cast("bigint"), *VIEWS)
    pool = zero.unionByName(more)
    has3 = pool.groupBy(*ITEM).agg(F.bool_and(filled("asr3")).alias("has3"))
    index = F.row_number().over(W.partitionBy(*ITEM).orderBy("r_no")) - 1
    return pool.join(has3, list(ITEM)).select(
        *ITEM, index.cast("bigint").alias("cand_idx"),
        F.when(F.col("r_no") >= 0, F.col("r_no")).alias("r_no"), "plan_text", "asr1", "asr2",
        F.when(F.col("has3"), F.col("asr3")).alias("asr3"))


def view_availability(long: DataFrame, *, minimum: float = 0.5) -> DataFrame:
    """(view, n, n_present, coverage, available): which views have enough extractions to form folds."""
    out = long.groupBy("view").agg(F.count(F.lit(1)).alias("n"), _count(F.col("present")).alias("n_present"))
    cov = ratio(F.col("n_present"), F.col("n"))
    return out.select("view", "n", "n_present", cov.alias("coverage"), (cov >= minimum).alias("available"))
