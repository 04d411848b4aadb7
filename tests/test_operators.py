import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factrail import dims
from factrail.dims import Pair, planned, spoken
from factrail.functions import observation as O
from factrail.operators import audit as U
from factrail.operators import merging as MG
from factrail.operators import pairing as P
from factrail.operators import quality as D
from factrail.operators import ranking
from factrail.operators import resampling as B
from factrail.operators import selection as S
from factrail.plans import metrics as M

FACT = "model string, item_id string, condition string, view string, type string, value string, polarity string"
OBS = "model string, item_id string, condition string, view string"


def tables(spark, facts, seen):
    f = spark.createDataFrame([("m", *r) for r in facts], FACT)
    o = spark.createDataFrame([("m", *r) for r in seen], OBS)
    return P.presence(f), P.observed_mask(o)


def test_unobserved_is_not_empty(spark):
    facts = [("a", "LISTEN", "text", "number", "1", "+"), ("b", "LISTEN", "text", "number", "2", "+"), ("b", "SPEAK", "asr1", "number", "2", "+")]
    seen = [("a", "LISTEN", "text"), ("b", "LISTEN", "text"), ("b", "SPEAK", "asr1")]
    p, o = tables(spark, facts, seen)
    pair = [Pair("x", spoken("SPEAK"), dims.TEXT_LISTEN)]
    rows = {k: P.pooled(P.item_counts(p, pair, o, missing=k), ["model"]).head() for k in ("exclude", "empty")}
    assert (rows["exclude"].retained, rows["exclude"].total) == (1, 1)
    assert (rows["empty"].retained, rows["empty"].total) == (1, 2)


def test_modes_need_every_companion(spark):
    facts = [("a", "SPEAK", v, "number", v[-1], "+") for v in ("asr1", "asr2")]
    p, o = tables(spark, facts, [("a", "SPEAK", "asr1"), ("a", "SPEAK", "asr2")])
    got = {r.mode: r.n_facts for r in M.compose_modes(p, o).collect()}
    assert got == {"asr1": 1, "asr2": 1, "union12": 2}
    with pytest.raises(ValueError):
        spoken("SPEAK", "asr9")


def test_loss_kinds_against_brute_force(spark):
    rng = random.Random(3)
    facts, seen = [], []
    for item in map(str, range(60)):
        seen += [(item, "SPEAK", "internal"), (item, "SPEAK", "asr1")]
        for view in ("internal", "asr1"):
            for _ in range(rng.randint(0, 8)):
                t = rng.choice(["number", "content", "negation"])
                v = str(rng.choice([-40, -33, -3, 0, 1, 2, 3, 5, 7.5, 90, 95, 100, 110, 1000, 1200, "x"])) if t == "number" else rng.choice("pqr")
                facts.append((item, "SPEAK", view, t, v, rng.choice("+-")))
    p, o = tables(spark, facts, seen)
    got = {(r.item_id, r.type, r.value, r.polarity): r.kind for r in P.classify_losses(p, spoken("SPEAK"), planned("SPEAK"), o).collect()}
    want = {}
    sets = lambda item, view: {f[3:] for f in facts if f[0] == item and f[2] == view}

    def num(x):
        try:
            return float(x)
        except ValueError:
            return None

    for item in map(str, range(60)):
        up, down = sets(item, "internal"), sets(item, "asr1")
        for t, v, pol in up - down:
            same = [d for d in down if d[0] == t]
            if any(d[1] == v and d[2] != pol for d in down):
                kind = "polarity_flip"
            elif not same:
                kind = "deletion"
            else:
                rel = [abs(num(v) - num(d[1])) / max(abs(num(v)), 1e-9) for d in same if t == "number" and num(v) is not None and num(d[1]) is not None]
                kind = "number_drift" if rel and min(rel) < 0.5 else "substitution"
            want[(item, t, v, pol)] = kind
    assert got == want and set(want.values()) == {"polarity_flip", "deletion", "number_drift", "substitution"}


def pool(spark, plan, views):
    """views[cand][view] = set of values."""
    pl = spark.createDataFrame([("m", "i", "number", v, "+") for v in plan], "model string, item_id string, type string, value string, polarity string")
    rows = [("m", "i", c, f"asr{k + 1}", "number", v, "+") for c, vs in enumerate(views) for k, s in enumerate(vs) for v in s]
    cd = spark.createDataFrame(rows, "model string, item_id string, cand_idx int, view string, type string, value string, polarity string")
    grid = spark.createDataFrame([("m", "i", c) for c in range(len(views))], "model string, item_id string, cand_idx int")
    return S.candidate_counts(pl, cd, grid)


def test_held_out_view_never_changes_the_pick(spark):
    plan = {"1", "2", "3"}
    base = [[{"1"}, {"1"}, set()], [{"1", "2"}, {"1", "2", "3"}, set()], [{"9"}, set(), set()]]
    for held, other in itertools.product(range(3), [{"1", "2", "3"}, set()]):
        changed = [[other if k == held else s for k, s in enumerate(vs)] for vs in base]
        picks = {r.evaluator: r.plan_guided_pick for r in S.select_folds(pool(spark, plan, changed)).collect()}
        reference = {r.evaluator: r.plan_guided_pick for r in S.select_folds(pool(spark, plan, base)).collect()}
        name = f"asr{held + 1}"
        assert picks[name] == reference[name]


def test_ties_go_to_the_earliest_candidate(spark):
    same = [[{"1"}, {"2"}, {"1"}], [{"2"}, {"1"}, {"1", "2"}], [{"1"}, {"2"}, {"1", "2"}]]
    row = {r.evaluator: r for r in S.select_folds(pool(spark, {"1", "2"}, same), ("plan_guided", "single")).collect()}["asr3"]
    assert row.plan_guided_pick == 0 and row.single_first_pick == 0 and row.oracle_pick == 1
    assert (row.base_gap, row.oracle_gap) == (0.5, 0.0)


def test_a_fact_travels_once_for_all_candidates_and_pools_beyond_a_word_are_counted(spark):
    fact = "model string, item_id string, type string, value string, polarity string"
    plan = spark.createDataFrame([("m", i, "number", v, "+") for i in "ab" for v in ("1", "2")] + [("m", "a", "number", None, "+")], fact)
    held = [("m", i, c, v, "number", x, "+") for i in "ab" for c in (0, 20, 21, 49) for v in ("asr1", "asr3") for x in ("1", str(c % 3))]
    cands = spark.createDataFrame(held + [("m", "c", 0, "asr1", "number", "1", "+"), ("m", "a", 3, "asr2", "number", None, "+")],
                                  "model string, item_id string, cand_idx int, view string, type string, value string, polarity string")
    grid = spark.createDataFrame([("m", i, c) for i in "abc" for c in range(50) if (i, c) != ("b", 21)], "model string, item_id string, cand_idx int")
    counts = S.candidate_counts(plan, cands, grid)
    rows = {(r.item_id, r.cand_idx): r for r in counts.collect()}
    assert set(rows) == {(i, c) for i in "ab" for c in range(50)} - {("b", 21)}
    for i, c in ((i, c) for i in "ab" for c in (0, 20, 21, 49) if (i, c) in rows):
        own = {"1", str(c % 3)}
        r = rows[i, c]
        assert (r.d_asr1, r.d_asr2, r.i_asr3, r.x_asr1_asr3) == (len(own), 0, len(own & {"1", "2"}), len(own)), (i, c)
    assert rows["a", 0].n_up == 3 and rows["b", 0].n_up == 2
    assert (rows["a", 3].d_asr2, rows["a", 3].i_asr2) == (1, 0)
    shuffles = [line for line in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("cand_idx" in line for line in shuffles)
    with pytest.raises(Exception, match="outside the pool"):
        S.candidate_counts(plan, cands, grid, pool=8).collect()


def test_budgets_take_the_first_candidates_of_a_pool(spark):
    views = [[{"1"}, {"1"}, {"1"}], [{"1", "2"}, {"1", "2"}, {"2"}], [{"1", "2", "3"}, {"1", "2", "3"}, {"3"}]]
    rows = {(r.budget, r.evaluator): r for r in S.budget_curve(pool(spark, {"1", "2", "3"}, views), (1, 2, 8)).collect()}
    assert [(rows[b, "asr3"].n_candidates, rows[b, "asr3"].plan_guided_pick) for b in (1, 2, 8)] == [(1, 0), (2, 1), (3, 2)]
    late = pool(spark, {"1", "2", "3"}, views).where("cand_idx > 0")
    assert {r.budget for r in S.budget_curve(late, (1, 2, 8)).collect()} == {2, 8}


def test_merge_keeps_polarity_and_is_independent_of_partitions(spark):
    schema = "k int, type string, value string, polarity string"
    rules = spark.createDataFrame([(1, "number", "95", "+"), (1, "negation", "95", "-"), (1, "proper_noun", "sun", "+")], schema)
    model = spark.createDataFrame([(1, "content", "sun", "+"), (1, "content", "95", "+"), (1, "content", "sky", "+")], schema)
    results = []
    for n in (1, 3, 7):
        out = MG.merge_channels(rules.repartition(n), model.repartition(n), ["k"])
        results.append({(r.value, r.polarity): (r.type, r.conflict, r.type_conflict) for r in out.collect()})
    assert results[0] == results[1] == results[2] == {
        ("95", "+"): ("number", False, True), ("95", "-"): ("negation", True, False), ("sun", "+"): ("content", False, True), ("sky", "+"): ("content", True, False)}


def test_duplicate_keys_are_an_error(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "key string, x int")
    with pytest.raises(Exception, match="repeated key a"):
        MG.unique_keys(df, ["key"]).collect()


@pytest.mark.parametrize("error, sec, text, expected", [
    (None, 1.0, "x", True), (None, 1.0, None, True), (None, None, "", True), (None, None, None, False), ("boom", 1.0, "x", False), ("", None, "x", True)])
def test_channel_state(spark, error, sec, text, expected):
    df = spark.createDataFrame([(error, sec, text)], "error string, sec double, text string")
    done = O.complete(F.col("error"), F.col("sec"), F.col("text"))
    row = df.select(done.alias("d"), O.completed_text(done, F.col("text")).alias("t")).head()
    assert row.d is expected and row.t == ((text or "") if expected else None)


def test_ranks_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(g, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for g in "ab" for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def rank(v):
        return [sum(o < x for o in v) + (sum(o == x for o in v) + 1) / 2 for x in v]

    for r in ranking.spearman(df, ["g"], "x", "y").collect():
        rx, ry = rank([x for g, x, _ in rows if g == r.g]), rank([y for g, _, y in rows if g == r.g])
        mx, my = sum(rx) / 200, sum(ry) / 200
        num = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
        den = (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
        assert r.n == 200 and r.rho == pytest.approx(num / den)
    flat = spark.createDataFrame([("a", 1.0, 2.0)] * 5, "g string, x double, y double")
    assert ranking.spearman(flat, ["g"], "x", "y").head().rho is None


def test_bootstrap_methods_agree(spark):
    rng = random.Random(7)
    rows = [("g", rng.randint(0, 5), 5, rng.randint(0, 4), 5) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, ra long, ta long, rb long, tb long")
    a = B.bootstrap_gap_difference(df, ["g"], replicates=400, method="slots").head()
    b = B.bootstrap_gap_difference(df.repartition(5), ["g"], replicates=400, method="multinomial").head()
    c = B.bootstrap_gap_difference(df.repartition(2), ["g"], replicates=400, method="multinomial").head()
    assert a["diff"] == b["diff"] and (b.ci_lo, b.ci_hi) == (c.ci_lo, c.ci_hi)
    assert abs(a.ci_lo - b.ci_lo) < 0.02 and abs(a.ci_hi - b.ci_hi) < 0.02 and a.n_boot == b.n_boot == 400


def test_permutation_tests_agree(spark):
    rng = random.Random(9)
    rows = [("g", i % 3 == 0, rng.randint(0, 50) + 5 * (i % 3 == 0), str(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, a boolean, x long, id string")
    p = B.permutation_test(df, ["g"], "a", "x", replicates=1000).head()
    q = B.permutation_test_ordered(df, ["g"], "a", "x", "id", replicates=1000).head()
    assert p["diff"] == pytest.approx(q["diff"]) and abs(p.p_value - q.p_value) < 0.06
    one = spark.createDataFrame([("g", True, 1, "a"), ("g", False, 2, "b")], "g string, a boolean, x long, id string")
    assert B.permutation_test_ordered(one, ["g"], "a", "x", "id", replicates=10).head().p_value is None


def test_claims_against_brute_force(spark):
    rng = random.Random(11)
    known = [round(rng.uniform(-2, 2), 4) for _ in range(80)]
    claims = sorted({f"{rng.uniform(0, 3):.{d}f}" for d in (1, 2, 3) for _ in range(60)})
    forms = D.known_forms(spark.createDataFrame([(k,) for k in known], "v double"), "v")
    got = {r.value: r.explained for r in D.explained_claims(spark.createDataFrame([(c,) for c in claims], "value string"), forms).collect()}
    allk = [f for k in known for f in (k, abs(k), abs(k) * 100)]
    want = {c: any(abs(k - float(c)) < 0.5 * 10 ** -len(c.split(".")[1]) + 1e-9 for k in allk) for c in claims}
    assert got == want and set(want.values()) == {True, False}


def test_sample_sizes_and_blinding(spark):
    rows = [(f"r{i % 2}", f"m{i % 3}", i, ["number", "unit"][i % 2], f"{i}.wav", ["all_differ", "two_agree", "all_three_agree"][i % 3 if i < 150 else 2]) for i in range(300)]
    c = spark.createDataFrame(rows, "run_id string, model string, item_id int, category string, audio string, stratum string")
    s = U.enriched_sample(c, 100, 1).collect()
    assert len(s) == 100 and len({r.audit_id for r in s}) == 100
    assert {k: sum(r.stratum == k for r in s) for k in ("all_differ", "two_agree")} == {"all_differ": 40, "two_agree": 35}
    assert [r.audit_id for r in U.enriched_sample(c.repartition(7), 100, 1).orderBy("audit_id").collect()] == sorted(r.audit_id for r in s)
    p = U.proportional_sample(c, 60, 1)
    assert p.count() == 60
    sheet = U.blind_sheet(U.enriched_sample(c, 100, 1), "annotator_2", 1)
    assert set(sheet.columns) == {"audit_id", "audio", "transcript", "notes", "sort_key"}
    with pytest.raises(ValueError):
        U.blind_sheet(c, "someone", 1)


def test_seed_manifest(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert {(r.item_id, r.cand_idx, r.seed) for r in B.seed_manifest(items, "5, 6,7", 2, candidate_offset=3).collect()} == {
        ("a", 3, 5), ("a", 4, 6), ("b", 3, 5), ("b", 4, 6)}
    with pytest.raises(ValueError, match="need 4 seeds"):
        B.seed_manifest(items, "1,2", 4)


def mixed(x, p, a, c):
    return pow((a * x + c) % p, 5, p)


def test_keyed_draws_against_plain_integers(spark):
    """The kernels against Python integers: positions, parts, sums, and the permutation."""
    from factrail.operators import draws as DR

    rng = random.Random(4)
    rows = [(g, rng.randint(0, 40), rng.randint(-3, 3)) for g in "ab" for _ in range(90)]
    df = spark.createDataFrame(rows, "g string, x long, y long")
    cells = B.cells_of(df, ["g"], ["x", "y"])
    p = DR.PRIME
    keys = {r.g: r.k for r in df.select("g").distinct().select("g", DR.hash_number(F.lit(5), F.col("g")).alias("k")).collect()}
    want = {}
    for g in "ab":
        line = sorted((x, y) for h, x, y in rows if h == g)
        for b in range(70):
            kb = pow((keys[g] % p + b * 40692) % p, 5, p)
            first = [mixed(s, p, 16807, kb) for s in range(90)]
            at = [(f * p + mixed(f, p, 48271, kb)) % 90 for f in first]
            want[g, b] = (sum(line[i][0] for i in at), sum(line[i][1] for i in at))
    for part in (DR.PART, 7):
        got = {(r.g, r.b): (r.x, r.y) for r in DR.bootstrap_sums(cells, ["g"], ["x", "y"], replicates=70, seed=5, part=part).collect()}
        assert got == want
    for size in (2, 7, 11, 90, 1000):
        q = DR.permuting_prime(size)
        assert sorted(DR.chosen_positions(np.arange(size, dtype=np.uint64), 123457, size, q)) == list(range(size))
    taken = DR.choice_sums(cells, ["g"], ["x"], F.lit(90), replicates=3, seed=5)
    assert all(r.x == sum(x for h, x, _ in rows if h == r.g) for r in taken.collect())


def test_joint_intervals(spark):
    rng = random.Random(8)
    rows = [("g", i, f, rng.randint(0, 4) / 4 + (0.2 if f == "two" else 0.0)) for i in range(300) for f in ("one", "two") if f == "one" or i % 3]
    df = spark.createDataFrame(rows, "g string, item long, fold string, x double")
    got = {r.fold: r for r in B.paired_intervals(df, ["g"], ["item"], "fold", ["one", "two", "none"], {"m": F.col("x")}, replicates=800, seed=3).collect()}
    assert set(got) == {"one", "two"}
    for f in got:
        xs = [x for _, _, h, x in rows if h == f]
        mean = sum(xs) / len(xs)
        spread = 1.96 * (sum((x - mean) ** 2 for x in xs) / len(xs) ** 2) ** 0.5
        assert got[f]["mean"] == pytest.approx(mean) and got[f].excludes_zero
        assert got[f].ci_lo == pytest.approx(mean - spread, abs=0.02) and got[f].ci_hi == pytest.approx(mean + spread, abs=0.02)
    # differences of paired statistics are drawn together: a constant difference has no spread
    wide = spark.createDataFrame([("g", "s" if i % 4 else "t", 3.0 if i % 4 else 1.0, float(i % 7), float(i % 7) - 2) for i in range(200)], "g string, s string, w double, a double, b double")
    j = {r.statistic: r for r in B.joint_intervals(wide.withColumn("d", F.col("a") - F.col("b")), ["g"], {"d": ("d", None), "a": ("a", None)}, replicates=200).collect()}
    assert (j["d"].ci_lo, j["d"].ci_hi) == (2.0, 2.0) and j["a"].ci_lo < j["a"]["mean"] < j["a"].ci_hi
    st = B.joint_intervals(wide, ["g"], {"a": ("a", None)}, replicates=200, stratum="s", weight="w").head()
    part = lambda s: sum(i % 7 for i in range(200) if (i % 4 > 0) == (s == "s")) / (150 if s == "s" else 50)
    assert st["mean"] == pytest.approx((3 * part("s") + part("t")) / 4) and st.ci_lo < st["mean"] < st.ci_hi


def test_positions_of_keys_with_a_long_common_prefix(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_ROWS", 40)
    keys = [f"{'same-prefix-of-20-bytes'}{i:05d}" for i in range(300)]
    df = spark.createDataFrame([(k, 1) for k in random.Random(1).sample(keys, 300)], "k string, n long")
    got = {r.k: r.before for r in ranking.running_totals(df, [], "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    assert {r.k for r in D.shard(df, "k", 7, 3).collect()} == set(keys[3::7])


@pytest.mark.parametrize("name", ["b01_bootstrap_exact", "b02_bootstrap_mean", "b03_bootstrap_linear", "b04_permutation_exact", "b04_permutation_counts"])
def test_registered_draws(spark, name):
    from factrail.plans import catalog, registry  # noqa: F401

    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_boot == 10_000 if "n_boot" in r else 0 < r.p_value <= 1 for r in rows)


def test_unlisted_values(spark):
    from factrail.operators import quality

    mentions = spark.createDataFrame([("1.5",), ("1.5",), ("2.5",), (None,), ("3.50",)], "value string")
    allowed = spark.createDataFrame([("1.5",), ("3.5",), (None,)], "value string")
    assert sorted(r.value for r in quality.unlisted(mentions, allowed).collect()) == ["2.5", "3.50"]
    assert quality.unlisted(mentions, allowed.limit(0)).count() == 3 and quality.unlisted(mentions.limit(0), allowed).count() == 0
