"""A training corpus from documents: language filter, exact duplicates, near duplicates, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; the last returns the packed pieces. After mixing a
document stands as often as the mix takes it, and each repetition is packed on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factrail.llm import exact_dedup, jaccard_join, langid, mixing, packing
from factrail.llm.common import documents, ship, stored

#: Tokenization and a learned model can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those in which no learned language holds a fair share of the words."""
    ship(spark)
    return langid.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest id stays."""
    ship(spark)
    return exact_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.75 or more, the smallest id stays."""
    ship(spark)
    return jaccard_join.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    ship(spark)
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the place they are packed to."""
    ship(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
