"""Exact duplicates of texts, equal after lower-casing A-Z, with the heavy hitters split off. DataFrame functions only.

A Misra-Gries type summary (approx_top_k) of the digests proposes frequent ones; an exact count verifies them. The verified
winners, at most TOP rows, are broadcast, and the losing copies of frequent texts are settled on the map side. What is left
has no key with more than about rows / TRACKED copies and goes through an ordinary shuffle by digest.

Cases: null text counts as empty; rows that repeat text and id are told apart by chance, and exactly one stays; a null id
loses to any other. Digests are SHA-256 of the normalised text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factrail.llm.common import lower_ascii, materialise

#: Counters of the summary, and the largest number of winners that is broadcast.
TRACKED = 8192
TOP = 1024


def digest(text):
    return F.unhex(F.sha2(lower_ascii(text), 256))


def heavy_hitters(digests: DataFrame) -> DataFrame:
    """(digest_, keep_, size_) of at most TOP frequent digests, exactly counted. digests: (doc_id, digest_)."""
    found = digests.agg(F.expr(f"approx_top_k(hex(digest_), {TOP}, {TRACKED})").alias("top")).select(F.explode("top").alias("t"))
    proposed = found.where("t.count > 1").select(F.unhex("t.item").alias("digest_"))
    counted = digests.join(F.broadcast(proposed), "digest_").groupBy("digest_").agg(F.max("doc_id").alias("keep_"), F.count("*").alias("size_"))
    return materialise(counted.where("size_ > 1"))


def _survivors(rows: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that the broadcast settles as lost, and the others with their place, keeper and size."""
    tagged = rows.join(F.broadcast(winners), "digest_", "left")
    lost = F.col("keep_").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_"))
    group = Window.partitionBy("digest_")
    rest = tagged.where(~lost).withColumns({
        "place_": F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())),
        "keep_": F.coalesce("keep_", F.max("doc_id").over(group)),
        "size_": F.coalesce("size_", F.count("*").over(group))})
    return tagged.where(lost), rest


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256 of every row."""
    digests = materialise(docs.select("doc_id", digest(F.col("text")).alias("digest_")))
    lost, rest = _survivors(digests, heavy_hitters(digests))
    out = lost.withColumn("kept", F.lit(False)).select("doc_id", "keep_", "size_", "kept", "digest_").unionByName(
        rest.select("doc_id", "keep_", "size_", (F.col("place_") == 1).alias("kept"), "digest_"))
    return out.select("doc_id", F.col("keep_").alias("keep_id"), F.col("size_").alias("group_size"), "kept", F.lower(F.hex("digest_")).alias("text_sha256"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", digest(F.col("text")).alias("digest_"))
    winners = heavy_hitters(rows.select("doc_id", "digest_"))
    _, rest = _survivors(rows, winners)
    return rest.where("place_ = 1").select("row_.*")
