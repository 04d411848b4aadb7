"""Mixes sources to target weights by capped water-filling.

Targets share the words of all documents by weight. A source that would be repeated more than max_epochs times is clamped
there and its excess goes to the others in proportion to their weights, until none is above its cap. A source whose target
is r times its words gives every document floor(r) whole times; the fractional rest takes documents in the order of a
seeded digest until the target is met. In `mix_words` the document at the edge gives a part of its words, so that each
source meets its target to the word; in `mixed` it is taken whole or not, whichever is nearer.

Sums, caps and levels are aggregates, one small job per level. The running sum of a source is built from totals of digest
buckets whose number grows with the rows, so a source with a third of all rows is no single task; only the one bucket at
a source's edge is ordered.

Cases: null and wordless texts have size 0 and are taken for 0 words; a null source comes last; sources without words have
target 0; rows that repeat count each on their own; a null id sorts first within its source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factrail.llm.common import materialise, positions

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_ROWS = 2048
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of every source. sizes: (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(totals, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while total:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        row = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("free"),
                         F.count_if(above).alias("capped")).first()
        if row.capped == capped:
            break
        capped, level = row.capped, (total - row.held) / row.free
    return ranked.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _placed(docs: DataFrame, extra: list, weights, max_epochs: int, seed: str) -> DataFrame:
    """Rows with source_size, target, whole_ (repetitions of each document), quota_ (words of the fractional pass) and
    before_ (words of the pass that come earlier; null beyond the edge)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("draw_"), *extra)
    if not extra:
        rows = materialise(rows)
    sizes = rows if not extra else materialise(rows.select("doc_id", "source", "size", "draw_"))
    targets = source_targets(sizes.select("source", "size"), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = materialise(targets.withColumn("whole_", whole).withColumn("quota_", F.round("target").cast("bigint") - F.col("whole_") * F.col("source_size")))
    digits = max(0, math.ceil(math.log(max(sizes.count() / BUCKET_ROWS, 1), 16)))
    cell = F.substring("draw_", 1, digits)
    sums = sizes.groupBy("source", cell.alias("cell_")).agg(F.sum("size").alias("inside_"))
    earlier = F.sum("inside_").over(Window.partitionBy("source").orderBy("cell_")) - F.col("inside_")
    p = plan.alias("p")
    cells = sums.withColumn("first_", earlier).alias("s").join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        F.col("s.source").alias("source_"), F.col("s.cell_").alias("there_"), "first_", "inside_", "source_size", "target", "whole_", "quota_")
    cells = materialise(cells)
    joined = rows.withColumn("cell_", cell).join(cells, F.col("source").eqNullSafe(F.col("source_")) & (F.col("cell_") == F.col("there_")))
    edge = (F.col("first_") < F.col("quota_")) & (F.col("first_") + F.col("inside_") > F.col("quota_"))
    order = Window.partitionBy("source_", "cell_").orderBy("draw_", "doc_id", "size")
    at_edge = joined.where(edge).withColumn("before_", F.col("first_") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # away from the edge a bucket is in or out as a whole
    others = joined.where(~edge).withColumn("before_", F.when(F.col("first_") < F.col("quota_"), F.lit(0).cast("bigint")))
    return at_edge.unionByName(others)


def mix_words(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source)."""
    rows = _placed(docs, [], weights, max_epochs, seed)
    inside = F.col("first_") + F.col("inside_") <= F.col("quota_")
    part = F.when(F.col("before_").isNull(), F.lit(0)).when(inside, F.col("size")).otherwise(
        F.greatest(F.least(F.col("size"), F.col("quota_") - F.col("before_")), F.lit(0)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole_") * F.col("size") + part).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    rows = _placed(docs, [F.struct(*docs.columns).alias("row_")], weights, max_epochs, seed)
    inside = F.col("first_") + F.col("inside_") <= F.col("quota_")
    once = F.col("before_").isNotNull() & (inside | (2 * F.col("before_") + F.col("size") <= 2 * F.col("quota_")))
    times = F.col("whole_") + once.cast("bigint")
    return rows.where(times > 0).select(F.explode(F.array_repeat("row_", times.cast("int"))).alias("row_")).select("row_.*")
