"""Queries on odd texts against their SQL, and the short forms of the text functions against the long ones."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factrail.dims import VIEWS
from factrail.functions import similarity as E
from factrail.functions import text as T
from factrail.operators import extraction as X
from factrail.operators import selection as S

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "the assistant said and the assistant left", "no marker, one assistant only", "sand and  and", "<|a|b|> <de>x</de>",
    "<\U0001f600\U0001f600> \x85 \x1c and  end　", "<a\nb> 1,000,000.50 and 007,,. 12.", "İstanbul ΑΣ straße 100% ① ٣ _x_9", "assistant\nand\n"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with odd texts among the documents."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in os.listdir(SMALL):
        if name != "documents.parquet":
            os.symlink(os.path.join(SMALL, name), os.path.join(folder, name))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    rows = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs.unionByName(rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), allowMissingColumns=True).coalesce(1).write.parquet(
        f"{folder}/documents.parquet")
    return folder


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = os.path.join(folder, t)
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    want = sorted(key(r) for r in cur.fetchall())
    return sorted(key([r[c] for c in names]) for r in entry.queries()[name](spark, folder).collect()) == want


def test_cleaning_of_odd_texts_is_that_of_its_sql(spark, odd):
    assert same_as_sql(spark, odd, "t09_cleaning")


@pytest.mark.parametrize("name", ["x01_numbers", "x02_units"])
def test_text_functions_on_odd_texts_are_those_of_their_sql(spark, odd, name):
    assert same_as_sql(spark, odd, name)


def test_numbers_before_a_line_end(spark):
    """A pattern's $ also matches before a last line end."""
    df = spark.createDataFrame([("6\x85",), ("6\n",), ("006",), ("1,5",)], "t string")
    assert [r.x for r in df.select(T.canon_number("t").alias("x")).collect()] == [None, "6", "6", "15"]


def test_short_integers_read_like_long_ones(spark):
    values = ["0", "000", "7", "007", "99", "100", "1000", "1005", "1100", "12000", "1000000", "20000045", "999999999999", "1000000000000", "100000000100"]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    rows = df.select(F.expr(T.integer_words_sql("d")).alias("a"), F.expr(T._long_integer_words_sql("d")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_common_ends_do_not_change_the_distance(spark):
    many = [f"w{i}" for i in range(300)]
    pairs = [("a b c d", "a b c d"), ("a b c d", "a c d"), ("a a a", "a a"), ("a b a b", "b a b a"), ("x a b y", "x y"), ("a", "b"), ("p q", "q p q p"),
             (" ".join(many), " ".join(reversed(many))), (" ".join(many), " ".join(many[1:] + ["z"]))]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", E.wer("a", "b").alias("w"), E.text_similarity("a", "b").alias("s"), E.word_similarity("a", "b").alias("r")).collect()
    for r in rows:
        x, y = r.a.split(), r.b.split()
        d = edits(x, y)
        assert (r.w, r.s, r.r) == (d / len(x), 1 - d / max(len(x), len(y)), 1 - d / max(len(x), len(y)))


def test_no_pattern_is_compiled_for_every_row(spark):
    """split compiles its pattern for every row unless it is a single character."""
    assert not [f for f in (T.words_sql("t"), T.canon_content_sql("t"), T.words_to_number_sql("t"), X.units_sql("t"), T.normalize_sql("t")) if "split(" in f]


def test_scores_of_repeated_candidate_texts_are_those_of_each_row(spark):
    said = ["order 12 costs 5%", "Order  12 costs five percent", "", None, "order 12 costs 5%"]
    rows = [("m", i, c, "Order 12 costs 5%" if i else None, said[c], said[(c + i) % 5], said[(2 * c + 1) % 5]) for i in range(3) for c in range(5)]
    df = spark.createDataFrame(rows, "model string, item_id long, cand_idx int, plan_text string, asr1 string, asr2 string, asr3 string")
    n = df.select("*", *[T.normalize_text(c).alias(f"n_{c}") for c in ("plan_text", *VIEWS)])
    want = n.select(*S.CAND, *[E.text_similarity("n_plan_text", f"n_{v}").alias(f"p_{v}") for v in VIEWS],
                    *[E.word_similarity(a, b).alias(f"t_{a}_{b}") for a, b in S.view_pairs()])
    got = S.text_scores(df)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_candidates_of_a_pool_are_counted_without_sorting_or_joining_their_rows(spark):
    from factrail.plans import fixtures as FX
    from factrail.plans.catalog_selection import pools

    got = FX.marked_facts(spark, SMALL)
    whole = S.marked_facts(FX.plan_facts(spark, SMALL), FX.candidate_facts(spark, SMALL)).select(*got.columns)
    assert got.count() == whole.count() and got.exceptAll(whole).count() == 0
    once = pools(spark, SMALL)
    plan = S.select_folds(once)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    by_rows = S.select_folds(S.candidate_counts(FX.plan_facts(spark, SMALL), FX.candidate_facts(spark, SMALL), FX.candidate_grid(spark, SMALL)))
    assert S.select_folds(once).exceptAll(by_rows).count() == 0 == by_rows.exceptAll(S.select_folds(once)).count()
    assert "pool" not in S.random_pick(once).columns and S.random_pick(once).count() == by_rows.count()


def test_texts_of_a_row_that_differ_in_case_alone_are_normalised_once_with_the_same_words(spark):
    rows = spark.createDataFrame([(x, y) for x in ODD for y in [*ODD, x and x.upper()]], "a string, b string")
    both = rows.select("a", "b", T.normalize_texts("a", "b").alias("n"), T.normalize_text("a").alias("x"), T.normalize_text("b").alias("y"))
    assert both.where("NOT (n.a <=> x AND n.b <=> y)").count() == 0


def test_survival_counts_distinct_samples_beyond_a_word(spark):
    from factrail.plans import metrics as M

    fact = "model string, item_id int, type string, value string, polarity string"
    plan = spark.createDataFrame([("m", 1, "number", "1", "+"), ("m", 1, "number", "2", "+"), ("m", 1, "number", None, "+")], fact)
    said = [("m", 1, "number", "1", "+", c, "asr1") for c in (0, 0, 5, 62, 63, 64, 200, None)] + [("m", 1, "number", None, "+", 3, "asr1")]
    cands = spark.createDataFrame(said, fact + ", cand_idx int, view string")
    grid = spark.createDataFrame([("m", 1, c) for c in range(201)], "model string, item_id int, cand_idx int")
    out = M.survival(plan, cands, grid)
    assert {r.value: r.survival for r in out.collect()} == {"1": 6, "2": 0, None: 0}
    assert not any("count(distinct" in line or "cand_idx" in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)


def test_facts_of_an_item_are_shuffled_once_for_the_nested_export(spark):
    from factrail.plans import fixtures as FX
    from factrail.sources import writers

    plan = writers.item_scores(FX.facts(spark, SMALL).drop("view"))._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and "condition" in line for line in plan.splitlines())


def shuffles(df):
    """The shuffles of a query, as the planner has them before the run, without those of a few sums."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_slots_are_counted_without_a_row_per_fact_and_slot_in_a_shuffle(spark):
    assert not any("condition" in line or "value" in line for line in shuffles(entry.queries()["s05_facts_long"](spark, SMALL)))


def test_slot_counts_of_repeated_and_negative_facts(spark):
    from factrail.operators import pairing as P

    rows = [("m", i, c, v, t, str(x), p) for i in (1, 2) for c, v in (("READ", "text"), ("SPEAK", "asr1"), ("SPEAK", "asr2")) for t, p in (("negation", "-"), ("negation", "+"), ("unit", "+"))
            for x in (1, 1, 2, 3) if not (i == 2 and v == "asr2") and not (v == "asr1" and p == "-" and x > i)]
    facts = spark.createDataFrame(rows, "model string, item_id int, condition string, view string, type string, value string, polarity string")
    once = facts.distinct().groupBy("condition", "view", "type").agg(
        F.count(F.lit(1)).alias("n_facts"), F.count_distinct("item_id").alias("n_items"), F.count_if(F.col("polarity") == "-").alias("n_negative"))
    assert sorted(map(tuple, P.slot_counts(P.presence(facts)).collect())) == sorted(map(tuple, once.collect()))


def test_marked_answers_are_sought_whatever_the_case_of_their_word(spark):
    from factrail.functions import answers as K

    rows = ["\\BOXED{3} then 4", "Final ANSWER is: 1,200 of 9", "the Result = -.5/2 and 7", "#### $12", "####x 8", "no digits, one answer", "İresult 5 ſ 6", "last − 3", "", None, "boxed 1 answer 2 #### 3"]
    plain = lambda p, g: f"try_element_at(regexp_extract_all(t, {T.q(p)}, {g}), -1)"
    long = f"replace(coalesce({plain(K.BOXED, 1)}, {plain(K.CUED, 1)}, {plain(K.HASHED, 1)}, {plain(K.NUM, 0)}), ' ', '')"
    df = spark.createDataFrame([(x,) for x in rows], "t0 string").selectExpr("t0", "replace(replace(t0, '−', '-'), '–', '-') AS t")
    got = df.select(K.numeric_answer("t0").alias("a"), F.expr(long).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == "3" and got[1].a == "1,200"
    assert "RLIKE '^[0-9]{1,9}" in K.rational_equal_sql("a", "b") and "contains(l, 'boxed')" in K.numeric_sql("t")
    pairs = spark.createDataFrame([("4", "8/2"), ("4/0", "4"), ("0/5", "0"), ("999999999/999999999", "1"), ("007", "7"), ("7\n", "7"), (None, "7"), ("1,000", "1000"), ("2/4", "3/6")], "a string, b string")
    assert [r[0] for r in pairs.coalesce(1).select(F.expr(K.rational_equal_sql("a", "b"))).collect()] == [True, False, True, True, True, True, False, True, True]


def test_texts_are_graded_without_a_row_per_source_in_a_shuffle(spark):
    """An item's predictions meet it by item alone; nothing but the numbers of a line is shuffled before the counts."""
    found = [line for name in ("k05_coverage_scoring", "k05_by_task", "k06_output_mode_gap") for line in shuffles(entry.queries()[name](spark, SMALL))]
    assert found and not any("gold" in line or "hashpartitioning(model" in line and "item_id" in line for line in found)


def test_grades_of_missing_failed_and_repeated_predictions(spark):
    from factrail.operators import tasks as TK

    items = spark.createDataFrame([("1", "gsm8k", None, "4"), ("2", "gsm8k", None, "5"), ("3", "gsm8k", None, "6")], "item_id string, dataset string, task string, gold string")
    fields = "model string, item_id string, condition string, error string, text string, " + ", ".join(f"{v} string, {v}_error string, {v}_sec double" for v in VIEWS)
    row = lambda m, i, c, e, t, a, ae=None: (m, i, c, e, t, a, ae, 1.0, a, None, None, None, "x", None)
    said = spark.createDataFrame([row("p", "1", "SPEAK", None, "it is 4", "5"), row("p", "1", "SPEAK", "", "it is 5", "4", "bad"), row("p", "2", "SPEAK", "boom", "5", "5"),
                                  row("q", "2", "LISTEN", None, None, "5"), row("q", "3", "SPEAK", None, "6", None)], fields)
    got = TK.graded(items, said, [("LISTEN", "internal"), ("SPEAK", "internal"), ("SPEAK", "asr1")])
    rows = sorted((r.model, r.item_id, r.condition, r.source, r.status, r.extracted or "", r.correct) for r in got.collect() if r.status != "missing")
    assert rows == [("p", "1", "SPEAK", "asr1", "error", "", None), ("p", "1", "SPEAK", "asr1", "ok", "5", False), ("p", "1", "SPEAK", "internal", "ok", "4", True),
                    ("p", "1", "SPEAK", "internal", "ok", "5", False), ("p", "2", "SPEAK", "asr1", "error", "", None), ("p", "2", "SPEAK", "internal", "error", "", None),
                    ("q", "2", "LISTEN", "internal", "ok", "", False), ("q", "3", "SPEAK", "asr1", "ok", "", False), ("q", "3", "SPEAK", "internal", "ok", "6", True)]
    assert got.where("status = 'missing'").count() == 20 - len(rows)


def test_long_lines_of_cells_are_looked_up_like_short_ones():
    """Positions of groups beyond four million items were searched one by one."""
    import numpy as np

    from factrail.operators import draws as D

    rng = np.random.default_rng(1)
    for size, k in ((7, 3), (70_000, 90), (10_800_000, 500)):
        start = np.r_[0, np.sort(rng.choice(np.arange(1, size), k - 1, replace=False))]
        n, at = np.diff(np.r_[start, size]), D.drawn_positions(D.slot_bases(np.arange(min(size, 50_000), dtype=np.uint64)), 991, size)
        whole, odd = (D.Cells(start[i:], n[i:], np.ones((k, 1))[i:], size) for i in (0, 1))
        assert (whole.table < 0).mean() < 0.05
        cell = np.searchsorted(start, at, side="right") - 1
        assert (whole.counts(at) == np.bincount(cell, minlength=k)).all() and (odd.counts(at) == np.bincount(cell, minlength=k)[1:]).all()
        part = D.Cells(start[::2], n[::2], np.ones((k, 1))[::2], size)
        assert (part.counts(at) == np.bincount(cell, minlength=k)[::2]).all()


def test_survival_takes_one_grouping_and_no_fact_in_a_shuffle(spark):
    from factrail.plans import fixtures as FX
    from factrail.plans import metrics as M
    from factrail.plans.catalog_paths import alive

    got, want = alive(spark, SMALL), M.survival(FX.plan_facts(spark, SMALL), FX.candidate_facts(spark, SMALL), FX.candidate_grid(spark, SMALL))
    assert not any("value" in line or "cand_idx" in line for line in shuffles(got))
    want = want.select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
