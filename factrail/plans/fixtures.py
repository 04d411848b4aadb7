"""Canonical tables derived from the driver's tables: the inputs of the registered queries.

Every table is a narrow expansion (explode of literal dimensions) of whole driver tables; nothing is
sampled. ``FX`` holds the same derivations as ANSI SQL common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factrail.dims import VIEWS
from factrail.session import parallelism, spread

# (condition, view, percent kept, salt)
FX_VIEWS = (
    ("READ", "text", 100, 1), ("LISTEN", "text", 95, 2),
    ("SPEAK", "internal", 94, 3), ("SPEAK", "asr1", 82, 4), ("SPEAK", "asr2", 76, 5), ("SPEAK", "asr3", 80, 6),
    ("ECHO", "internal", 96, 7), ("ECHO", "asr1", 78, 8),
    ("EF", "internal", 98, 9), ("EF", "asr1", 84, 10),
    ("EFA", "internal", 97, 11), ("EFA", "asr1", 83, 12),
    ("EFB", "internal", 98, 13), ("EFB", "asr1", 85, 14),
    ("SPEAKD", "internal", 94, 15), ("SPEAKD", "asr1", 86, 16),
)
N_CANDIDATES = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def literal_rows(names: tuple[str, ...], rows: list[tuple]) -> Column:
    """A literal array of structs; integers become BIGINT."""
    def lit(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}L"

    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {lit(v)}" for n, v in zip(names, row)) + ")" for row in rows)
    return F.expr(f"array({structs})")


def views_column() -> Column:
    return literal_rows(("condition", "view", "keep_pct", "salt"), list(FX_VIEWS))


def model_of(item: Column) -> Column:
    return F.concat(F.lit("m"), (item % 5).cast("string"))


def base(spark: SparkSession, sf: str, by_item: bool = False) -> DataFrame:
    """(item_id, model, type, v, polarity): the distinct facts of an order.

    ``by_item``: two numbers a line are dealt by item before anything is derived from them, so that what is derived of an
    item is grouped without a further shuffle. An item then lies in one task; without it, the facts of one item spread.
    """
    k, v = F.col("l_orderkey"), F.col("l_partkey")
    lines = table(spark, sf, "lineitem").select(k.alias("item_id"), v.alias("v"))
    if by_item:
        model = model_of(F.col("item_id")).alias("model")
        lines = lines.select("item_id", "v", model).repartition(parallelism(spark), "model", "item_id").distinct()
        return typed(lines)
    return typed(lines.distinct())


def typed(facts: DataFrame) -> DataFrame:
    """The model, type and sign of (item_id, v)."""
    return facts.select(
        "item_id", "model" if "model" in facts.columns else model_of(F.col("item_id")).alias("model"),
        F.when(F.col("v") % 5 == 0, "number").when(F.col("v") % 5 == 1, "unit")
        .when(F.col("v") % 5 == 2, "proper_noun").when(F.col("v") % 5 == 3, "negation")
        .otherwise("content").alias("type"),
        "v", F.when(F.col("v") % 5 == 3, "-").otherwise("+").alias("polarity"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, model) of every order that has a line."""
    return (
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id")).distinct()
        .select("item_id", model_of(F.col("item_id")).alias("model"))
    )


def is_observed(item: Column, view: Column, salt: Column) -> Column:
    return view.isin("text", "internal") | (((item * 7919 + salt * 104729) % 1000003) % 20 != 0)


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """(model, item_id, condition, view): about 5 % of the transcripts are missing."""
    return (
        items(spark, sf).select("model", "item_id", F.explode(views_column()).alias("c"))
        .where(is_observed(F.col("item_id"), F.col("c.view"), F.col("c.salt")))
        .select("model", "item_id", "c.condition", "c.view")
    )


def facts(spark: SparkSession, sf: str, by_item: bool = False) -> DataFrame:
    """(model, item_id, condition, view, type, value, polarity), possibly with repeated rows.

    Kept facts stay; some lost numbers and contents drift to a neighbour and some lost negations
    lose their sign.
    """
    i, v = F.col("item_id"), F.col("v")
    salt = F.col("c.salt")
    kept = ((i * 2654435 + v * 40503 + salt * 69069) % 1000003) % 100 < F.col("c.keep_pct")
    drift = (F.col("type") == "number") & ((i * 31 + v * 17 + salt) % 3 == 0)
    swap = (F.col("type") == "content") & ((i * 41 + v * 13 + salt) % 4 == 0)
    flip = (F.col("type") == "negation") & ((i * 37 + v * 11 + salt) % 4 == 0)
    return (
        base(spark, sf, by_item).select("*", F.explode(views_column()).alias("c"))
        .where(is_observed(i, F.col("c.view"), salt) & (kept | drift | swap | flip))
        .select(
            "model", "item_id", "c.condition", "c.view", "type",
            F.when(kept | flip, v).otherwise(v + 5).cast("string").alias("value"),
            F.when(~kept & flip, "+").otherwise(F.col("polarity")).alias("polarity"),
        )
    )


def agree_flags(spark: SparkSession, sf: str) -> DataFrame:
    """(model, item_id, agree, wer): the stored readback metrics of an item's speech."""
    i = F.col("item_id")
    return items(spark, sf).select(
        "model", "item_id",
        ((i * 13 + 7) % 4 != 0).alias("agree"),
        F.when(i % 17 != 0, ((i * 7919) % 41).cast("double") / 40).alias("wer"),
    )


def candidate_grid(spark: SparkSession, sf: str) -> DataFrame:
    """(model, item_id, cand_idx): every candidate of every item, also those without any fact."""
    cands = F.expr(f"explode(sequence(0, {N_CANDIDATES - 1})) AS cand_idx")
    return items(spark, sf).select("model", "item_id", cands)


def plan_facts(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select("model", "item_id", "type", F.col("v").cast("string").alias("value"), "polarity")


def candidate_facts(spark: SparkSession, sf: str) -> DataFrame:
    """(model, item_id, cand_idx, view, type, value, polarity): 8 candidates in three views."""
    spec = literal_rows(("cand_idx", "view", "salt"), [
        (c, a, s) for c in range(N_CANDIDATES) for a, s in zip(VIEWS, (11, 12, 13))])
    i, v, c, s = F.col("item_id"), F.col("v"), F.col("k.cand_idx"), F.col("k.salt")
    keep = ((i * 2654435 + v * 40503 + c * 7919 + s * 69069) % 1000003) % 100 < F.when(
        v % 7 == 0, 12).otherwise(60 + (i * 7 + c * 13) % 35)
    drift = (F.col("type") == "number") & ((i * 31 + v * 17 + c * 3 + s) % 3 == 0)
    return (
        base(spark, sf).select("*", F.explode(spec).alias("k"))
        .where(keep | drift)
        .select("model", "item_id", F.col("k.cand_idx").cast("int").alias("cand_idx"), "k.view", "type",
                F.when(keep, v).otherwise(v + 5).cast("string").alias("value"), "polarity")
    )


def marked_facts(spark: SparkSession, sf: str, views: tuple[str, ...] = VIEWS, by_item: bool = False) -> DataFrame:
    """``candidate_facts`` of some views and ``plan_facts`` (candidate -1, view plan) in one pass over the facts of an order,
    which lie in partitions enough that a task's facts stay in memory; ``by_item`` as in ``base``."""
    spec = literal_rows(("cand_idx", "view", "salt"), [(-1, "plan", 0)] + [
        (c, a, s) for c in range(N_CANDIDATES) for a, s in zip(VIEWS, (11, 12, 13)) if a in views])
    i, v, c, s = F.col("item_id"), F.col("v"), F.col("k.cand_idx"), F.col("k.salt")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("v"))
    keep = (F.col("k.view") == "plan") | (((i * 2654435 + v * 40503 + c * 7919 + s * 69069) % 1000003) % 100 < F.when(
        v % 7 == 0, 12).otherwise(60 + (i * 7 + c * 13) % 35))
    drift = (F.col("type") == "number") & ((i * 31 + v * 17 + c * 3 + s) % 3 == 0)
    return (
        (base(spark, sf, True) if by_item else typed(lines.repartition(parallelism(spark), "item_id", "v").distinct())).select("*", F.explode(spec).alias("k"))
        .where(keep | drift)
        .select("model", "item_id", "type", F.when(keep, v).otherwise(v + 5).cast("string").alias("value"), "polarity",
                F.col("k.cand_idx").cast("int").alias("cand_idx"), "k.view")
    )


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """(model, item_id, cand_idx, duration): audio seconds, unknown for some candidates."""
    i, c = F.col("item_id"), F.col("cand_idx")
    return candidate_grid(spark, sf).select(
        "model", "item_id", "cand_idx",
        F.when((i + c) % 9 != 0, (F.lit(4) + (i * 3 + c * 5) % 11).cast("double")).alias("duration"),
    )


# Phrases with number words, units, names and negation cues for the sentence fixture.
PHRASES = (
    "two thousand five hundred meters", "two and a half kg", "seventeen hours", "three point five km/h",
    "one hundred and five days", "twenty-five percent", "ninety five degrees celsius", "no more than a minute",
    "one million two hundred thousand bytes", "forty litres of Zn", "half a day", "sixteen apples",
)


def sentences(spark: SparkSession, sf: str, by_item: bool = False) -> DataFrame:
    """(item_id, text): one ASCII sentence per distinct line of an order; the id is unique.

    ``by_item``: the lines are dealt by that id, so that what is grouped or joined by it is not shuffled again.
    """
    o, n, q, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "q", "l_partkey", "l_suppkey"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), "l_partkey", "l_suppkey"
    )
    key = F.concat_ws("-", o, n, q, p, s)
    rows = rows.withColumn("item_id", key).repartition(parallelism(spark), "item_id").distinct() if by_item else rows.distinct().withColumn("item_id", key)
    st = lambda c: c.cast("string")
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), ((p % len(PHRASES)) + 1).cast("int"))
    kind = (o + n + s) % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("Order "), st(o), F.lit(" weighs "), st(q),
               F.lit(" kilograms, costs 5% more than "), st(p), F.lit(" and Gold is not in group "), st(s), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("The sample of Au took "), phrase, F.lit(" and "), st(q),
              F.lit(".5 kg. "), st(p * 1000 + s), F.lit(" is not even, never was Hg.")))
        .when(kind == 2, F.concat(F.lit("It's "), phrase, F.lit(", said Maria Lopez. The crocodile isn't in class "),
              st(s), F.lit("!")))
        .when(kind == 3, F.concat(st(p * 1001), F.lit(" bytes or "), st(q), F.lit(",250 grams? "), phrase,
              F.lit(" cannot be neon, except in New York.")))
        .when(kind == 4, F.concat(F.lit("No answer for "), st(o), F.lit(". The value of NA is none, not "), phrase,
              F.lit(".")))
        .otherwise(F.concat(phrase, F.lit(" and "), st(q), F.lit(" km of copper wire; result: "), st(s),
                   F.lit("/"), st(q + 1), F.lit(" GB are excluding No "), st(n), F.lit(".")))
    )
    return rows.select("item_id", text.alias("text"))


def heard(text: Column, item_number: Column, view: int) -> Column:
    """A transcript of a sentence: each view mishears in its own deterministic way."""
    k = (item_number * 31 + view * 7) % 6
    low = F.lower(text)
    return (
        F.when(k == 0, low)
        .when(k == 1, F.replace(F.replace(low, F.lit(" and "), F.lit(" an ")), F.lit(" is "), F.lit(" ")))
        .when(k == 2, F.replace(F.replace(text, F.lit(" not "), F.lit(" ")), F.lit("kg"), F.lit("kilos")))
        .when(k == 3, F.concat(F.lit("well "), F.replace(text, F.lit("The "), F.lit("A "))))
        .when(k == 4, F.when(item_number % 7 == 0, F.lit("")).otherwise(F.replace(low, F.lit("five"), F.lit("nine"))))
        .otherwise(text)
    )


def transcripts(spark: SparkSession, sf: str, by_item: bool = False) -> DataFrame:
    """(item_id, text, asr1, asr2, asr3): the sentence and what three observers heard. The number that decides on the
    mishearings is read off the id once, in a step of its own."""
    num = F.split_part("item_id", F.lit("-"), F.lit(1)).cast("bigint") + F.length("item_id")
    return sentences(spark, sf, by_item).select("*", num.alias("num")).select(
        "item_id", "text", *[heard(F.col("text"), F.col("num"), i + 1).alias(v) for i, v in enumerate(VIEWS)]
    )


def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(model, item_id, plan_text, cand_idx, asr1..asr3): plan sentence and candidate transcripts of an order."""
    i = F.col("o_orderkey")
    plan = F.concat(
        F.lit("Order "), i.cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"),
        F.lit(" has status "), F.col("o_orderstatus"), F.lit(" and costs 12 percent more"))
    cand = F.expr(f"explode(sequence(0, {N_CANDIDATES - 1})) AS cand_idx")
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    rows = orders.select(model_of(i).alias("model"), i.alias("item_id"), plan.alias("plan_text"), cand)

    def spoken(view: int) -> Column:
        k = (F.col("item_id") * 13 + F.col("cand_idx") * 5 + view * 3) % 7
        t = F.col("plan_text")
        return (
            F.when(k == 0, t)
            .when(k == 1, F.replace(t, F.lit(" of customer "), F.lit(" customer ")))
            .when(k == 2, F.lower(F.replace(t, F.lit("12 percent"), F.lit("twelve percent"))))
            .when(k == 3, F.replace(F.replace(t, F.lit(" has "), F.lit(" had the ")), F.lit("12"), F.lit("20")))
            .when(k == 4, F.concat(F.lit("order "), F.col("item_id").cast("string")))
            .when(k == 5, F.replace(t, F.lit("status"), F.lit("state")))
            .otherwise(F.concat(t, F.lit(", you know.")))
        )

    return rows.select("*", *[spoken(i + 1).alias(v) for i, v in enumerate(VIEWS)])
