"""What FINDINGS_r04 asked for: joins that are not broadcast, batches of texts against the expressions they stand for."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from factrail.functions import similarity as E
from factrail.functions import text as T
from factrail.functions.batches import compared
from factrail.llm import simhash
from factrail.operators import pairing as P
from factrail.operators import selection as S
from factrail.plans import fixtures as FX
from factrail.plans import marts as R
from factrail.plans import metrics as M
from factrail.plans.catalog_selection import pools

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_an_index_are_never_broadcast(spark):
    """An explode counts as one row in Spark's estimate; 70 entries a fingerprint are far more than that says."""
    nodes = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in physical(simhash.list_members(nodes))


ODD = [None, "", " ", "Order 12 costs 5%", "order  12 costs five percent", "x5kg 1,2.5,3 ,.5", "007 000 1,000,000.50 12.", "İstanbul ΑΣ straße 100% ٣", "a\x1cb\tc\x02d\x03",
       "\x85 1 　two", "9" * 307 + " and " + "9" * 306, "twenty-five 25 1,5kg 1.2.3", " ".join(f"w{i % 90}" for i in range(300)), " ".join(f"w{i % 77}" for i in range(280))]


def test_texts_compared_in_batches_score_as_the_expressions_do(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    n = df.select("*", T.normalize_text("a").alias("x"), T.normalize_text("b").alias("y"))
    want = n.select("i", E.wer("x", "y").alias("w"), E.text_similarity("x", "y").alias("s"), E.word_similarity("a", "b").alias("r"))
    got = compared(df, ["i"], ["a", "b"], [("w", "a", "b", "wer"), ("s", "a", "b", "normal"), ("r", "a", "b", "raw")])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_candidate_rows_are_never_formed_to_judge_picks_by_type(spark):
    picks = S.select_folds(pools(spark, SMALL)).withColumn("plan_text_pick", F.pmod(F.col("item_id"), F.lit(9)))
    got = S.typed_losses(picks, pools(spark, SMALL, by_type=True))
    rows = S.typed_losses(picks, S.pool_rows(pools(spark, SMALL, by_type=True)))
    assert got.count() > 0 == got.exceptAll(rows).count() == rows.exceptAll(got).count()
    assert "explode(pool" not in physical(got)


def test_a_fold_is_graded_once(spark):
    """The picks stood on both sides of a join, and everything below them was computed twice."""
    picks = S.select_folds(pools(spark, SMALL), ("plan_guided", "fact_consistency"))
    texts = FX.order_texts(spark, SMALL).select("model", "item_id", F.col("cand_idx").cast("bigint").alias("pick"), "asr1", "asr2", "asr3")
    out = R.downstream_accuracy(picks, texts, ("original", "plan_guided", "fact_consistency", "oracle"), gold="12")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("orders.parquet") <= 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_gold_is_compared_without_joining_or_shuffling_the_candidates_facts(spark):
    rows = [("m", 1, "number", v, "+", c, view) for v, c, view in [
        ("1", -1, "plan"), ("2", -1, "plan"), (None, -1, "plan"), ("1", 0, "a"), ("1", 0, "a"), ("1", 70, "a"), ("9", 0, "a"), (None, 1, "a"), ("2", 0, "b")]]
    rows += [("m", 2, "number", "1", "+", 0, "a"), ("m", 3, "unit", "g", "+", -1, "plan")]
    marked = spark.createDataFrame(rows, "model string, item_id long, type string, value string, polarity string, cand_idx int, view string")
    readings = spark.createDataFrame([("m", i, c, v) for i in (1, 2, 3) for c in (0, 1) for v in ("a", "b", "c")], "model string, item_id long, cand_idx int, view string")
    got = {r.view: tuple(r)[2:] for r in M.gold_comparison(marked, readings, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 8, 4, 2 / 8, 2 / 4), "b": (2, 8, 1, 1 / 8, 0.0), "c": (2, 8, None, None, None)}
    q = entry.queries()["j15_gold_comparison"](spark, SMALL)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_rewrites_judged_in_one_grouping_are_those_of_the_joins(spark):
    cands, grid = FX.candidate_facts(spark, SMALL), FX.candidate_grid(spark, SMALL)
    variant = F.when(F.col("view") == "asr2", "ORIG").when(F.col("view") == "asr3", "REWRITE")
    facts = cands.withColumn("variant", variant).where("variant IS NOT NULL").withColumnRenamed("cand_idx", "sample")
    readings = P.dimension(grid.withColumnRenamed("cand_idx", "sample"), "variant", ["ORIG", "REWRITE"])
    want = M.judge_rewrite(M.structural_targets(M.survival(FX.plan_facts(spark, SMALL), cands, grid)), readings, facts)
    got = entry.queries()["a26_rewrite_judgement"](spark, SMALL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_plain_words_skip_the_tests_of_cues_numbers_and_symbols(spark):
    """Most words of a text only become the last word before a cue; each went through every test of the fold."""
    from factrail.operators import extraction as X

    assert "(a, w) -> CASE WHEN w >= '0' AND w < ':'" in X.negations_sql("s")
    texts = ["Gold is not No 5", "x5kg isn't, never 1,5", "Five hundred cannot", "No no No", "99 and a half none", "The Ab cd never", "a_not not", "9" * 400 + " no", "can't Au five-six except"]
    facts = spark.createDataFrame([(t,) for t in texts], "s string").select("s", F.expr(X.negations_sql("s")).alias("f")).collect()
    got = [[(x.type, x.value, x.polarity) for x in r.f] for r in facts]
    five, no = [("negation", "500", "-"), ("number", "500", "+")], [("negation", "no", "-"), ("proper_noun", "no", "+")]
    assert got[2] == five and got[3] == no + no
    assert got[0] == [("negation", "gold", "-"), ("negation", "not", "-")] and got[7] == []
