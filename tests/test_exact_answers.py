"""Inputs on which rounding, lenient parsing or silence would give a wrong answer."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factrail.functions import answers as K, text as T
from factrail.operators import audit, extraction as X

PAIRS = [
    ("0.0000001/1", "0/1"), ("1.0000004/2", "0.5"), ("12345678901234567890/2", "6172839450617283945"), ("1/3", "2/6"), ("-1/3", "1/-3"), ("1/0", "1/0"), ("0/5", "0"),
    ("1/3", "0.333333"), ("1,000/4", "250"), ("-0/3", "0/7"), (".5/1", "1/2"), ("3.", "6/2"), ("1" * 60 + "/3", "2" * 60 + "/6"), ("1" * 60 + "/3", "2" * 59 + "3/6"), ("x/2", "1/2"),
    ("999999999999/1000001", "999998999999999999/1000000000000"), ("1e3/1", "1000"),
]


def truth(a, b):
    def value(x):
        top, _, low = x.replace(",", "").partition("/")
        return Fraction(top) / Fraction(low or "1")
    try:
        return "e" not in a + b and value(a) == value(b)
    except (ZeroDivisionError, ValueError):
        return False


def test_fractions_compare_exactly(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    got = [r[0] for r in df.coalesce(1).select(F.expr(K.rational_equal_sql("a", "b"))).collect()]
    assert got == [truth(a, b) for a, b in PAIRS]


def test_large_integers_keep_every_digit(spark):
    raw = ["123456789012345678901", "9007199254740993", "9223372036854775808", "-123456789012345678901", "1" + "0" * 38, "9" * 100, "7" * 300, "18446744073709551616", "36893488147419103231", "42.0", "1000000000000000000000000.5"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").coalesce(1).select(T.canon_number("raw")).collect()]
    assert got == [str(int(float(x))) for x in raw]


def test_bad_elements_and_trailing_text(spark):
    raw = ['{"facts":["x",{"type":"unit","value":"kg"},3,null,[1]]}', '{"facts":[{"type":"unit","value":"kg"}]} note }', 'so: {"facts":[{"type":"unit","value":"kg"}]} done', '{"facts":[]}{"facts":[]}']
    rows = X.parse_model_output(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [r.llm_error for r in rows] == [None, "json decode error", None, "json decode error"]
    assert [[f.value for f in r.facts_llm] for r in rows] == [["kg"], [], ["kg"], []]


def test_a_short_sample_is_an_error(spark):
    rows = spark.createDataFrame([("r", "m", i, "c", "all_differ") for i in range(3)], "run_id string, model string, item_id int, category string, stratum string")
    assert audit.enriched_sample(rows, 3, 1).count() == 3
    for few in (rows, rows.where("false")):
        with pytest.raises(Exception, match="cannot select 10 rows"):
            audit.enriched_sample(few, 10, 1).collect()


def test_labels_start_unknown(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c")], "item_id int, asr1 string, asr2 string, asr3 string")
    assert audit.packet(rows).first().human.annotator_1.facts is None
