"""How the filters of a cleaning chain interact: every order of five filters, folded over counted mask cells.

A document enters only through which filters it fails, so documents are counted per part and mask first. Every cell then
folds, with aggregate and transform, across the array of all orders (a literal of 120 entries that the plan carries to
every task): one weighted struct per order and step, 600 in all, whose elements are added up per part. Work after
the counting grows with parts and masks, not with documents.

Equal texts have equal masks but for the last filter, which fails every document with a larger id than the least of its text.
Documents are counted per text digest (pre-aggregated, so a text that a third of all rows share is a few rows) and only the
counts meet: the rows of the least id pass, the others fail.

Cases: null text counts as empty, null lang as the empty string; a null id sorts after all others, and rows that repeat the
least id of a text all pass the last filter; a label is set where any row of labels for the id sets it; labels without
a document count nowhere; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
MARKS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(F.struct(words.alias("words"), text.alias("text"))), lambda t: (
        F.when(F.size(t["words"]) < WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(t["words"])) < DISTINCT_PERCENT * F.size(t["words"]), 2).otherwise(0)
        + F.when(100 * (F.length(t["text"]) - F.length(F.translate(t["text"], _UPPER, ""))).cast("bigint") > UPPER_PERCENT * F.length(t["text"]).cast("bigint"), 4).otherwise(0)
        + F.when(t["text"].rlike(MARKS), 8).otherwise(0)))[0]


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): counted documents per part and set of failed filters."""
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text).alias("mask"))
    flags = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    keys = ["digest", "mask", "part", "good", "toxic"]
    never = F.lit(False)
    known = marked.join(flags, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "digest", "mask", "part",
        F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic"))
    per_id = known.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("k"))
    grouped = per_id.groupBy(*keys).agg(F.sum("k").alias("n"), F.min(F.struct("doc_id", "k")).alias("first"))
    # rows of one digest here: parts x labels, however many documents share the text
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    passing = F.when(F.col("first.doc_id") == least, F.col("first.k")).otherwise(0)
    split = grouped.withColumn("pass", passing).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("pass").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("pass")).alias("n")))).alias("c"))
    return split.select("part", "good", "toxic", "c.*").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


def _fold(order: Column) -> Column:
    """The steps of one order for a cell: an array of weighted structs, one per filter."""
    mask, none = F.col("mask"), F.lit(0).cast("bigint")
    step_type = "array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(step_type).alias("steps"))

    def step(state: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        now = fails & ~state["gone"]
        gone = state["gone"] | fails
        weigh = lambda test, n: F.when(test, F.col(n)).otherwise(none)
        counts = F.struct(
            weigh(~gone, "n").alias("kept"), weigh(now, "n").alias("removed"), weigh(fails & state["gone"], "n").alias("redundant"),
            weigh(mask == bit, "n").alias("unique_fails"), weigh(now, "n_good").alias("good_lost"), weigh(now, "n_toxic").alias("toxic_lost"))
        return F.struct(gone.alias("gone"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    return F.aggregate(order, start, step, lambda state: state["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    bits = F.array(*[F.array(*[F.lit(1 << LETTERS.index(f)) for f in order]) for order in ORDERS])
    folded = mask_cells(docs, labels).select("part", F.flatten(F.transform(bits, _fold)).alias("all"))
    summed = folded.select("part", F.posexplode("all").alias("at", "s")).groupBy("part", "at").agg(*[F.sum(f"s.{c}").alias(c) for c in COUNTS])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.floor(F.col("at") / 5).cast("int") + 1)
    rows = summed.select("part", order.alias("filter_order"), (F.col("at") % 5 + 1).cast("int").alias("step"), *COUNTS)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))
