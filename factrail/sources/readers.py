"""Readers of run artifacts: explicit schemas, no inference, corrupt lines kept as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factrail import dims
from factrail.functions.text import text_hash

SHARD_FILE = r"_shard[0-9]+-of-[0-9]+[.]jsonl$"


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType, *, multiline: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("multiLine", multiline).json(path)


def items(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, dims.ITEMS)


def benchmark_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, dataset, task, gold) of a manifest that must hold one dataset."""
    from factrail.operators.tasks import require_one_dataset

    return require_one_dataset(items(spark, path).select(
        F.col("id").alias("item_id"), F.col("category").alias("dataset"), F.col("difficulty").alias("task"),
        F.col("expected_answer_text").alias("gold")))


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Tree <root>/<run>/predictions/<model>/<item>/<CONDITION>.json, one record per file.

    Many small files: compact the result to Parquet partitioned by run and model before using it.
    """
    df = read_json(spark, f"{root}/*/predictions/*/*/*.json", dims.PREDICTIONS, multiline=True)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"([^/]+)/predictions/([^/]+)/([^/]+)/([^/]+)[.]json$", i)
    return df.select(
        part(1).alias("run_id"), part(2).alias("model"), part(3).alias("item_id"), part(4).alias("condition"),
        *[c for c in df.columns if c not in ("item_id", "condition")])


def resamples(spark: SparkSession, root: str) -> DataFrame:
    """Tree <root>/<model>/<item>/R<k>.json of extra candidates."""
    df = read_json(spark, f"{root}/*/*/R*.json", dims.CANDIDATES, multiline=True)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/R([0-9]+)[.]json$", i)
    return df.select(part(1).alias("model"), part(2).alias("item_id"), part(3).cast("bigint").alias("r_no"),
                     *[c for c in df.columns if c != "item_id"])


def readbacks_long(predictions_df: DataFrame) -> DataFrame:
    """(run_id, model, item_id, condition, channel, text, error, sec, version, duration) from the nested records."""
    rows = F.array(*[
        F.struct(
            F.lit(v).alias("channel"), F.col(f"readback.{v}").alias("text"), F.col(f"readback.{v}_error").alias("error"),
            F.col(f"readback.{v}_sec").alias("sec"), F.element_at("readback.asr_versions", F.lit(v)).alias("version"))
        for v in dims.VIEWS])
    return predictions_df.where("readback IS NOT NULL").select(
        "run_id", "model", "item_id", "condition", F.col("audio_duration_sec").alias("duration"), F.explode(rows).alias("r")
    ).select("run_id", "model", "item_id", "condition", "r.*", "duration")


def extractions(spark: SparkSession, path: str | list[str], *, prompt_sha256: str | None = None, model_facts: bool = True) -> DataFrame:
    """Fact cache with one row per key: the key or item|condition, corrupt lines dropped, last line wins.

    Lines are ordered by file and position in the file, so the last line of the last file stands.
    """
    df = read_json(spark, path, dims.EXTRACTIONS)
    return last_extractions(df.withColumn("ordinal", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())),
                            prompt_sha256=prompt_sha256, model_facts=model_facts)


def last_extractions(df: DataFrame, *, prompt_sha256: str | None = None, model_facts: bool = True) -> DataFrame:
    from factrail.operators.merging import last_per_key

    key = F.coalesce(F.nullif(F.col("key"), F.lit("")), F.when(
        (F.col("item_id") != "") & (F.col("condition") != ""), F.concat_ws("|", "item_id", "condition")))
    rows = df.withColumn("key", key).where(F.col("key").isNotNull())
    if "_corrupt_record" in rows.columns:
        rows = rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if prompt_sha256 is not None:
        rows = rows.where(F.col("prompt_sha256").eqNullSafe(F.lit(prompt_sha256)))
    out = last_per_key(rows, ["key"], "ordinal")
    if not model_facts:
        out = out.withColumn("facts_llm", F.array().cast(dims.FACTS)).withColumn("facts", F.col("facts_rules"))
    return out.drop("ordinal")


def extraction_jobs(records: DataFrame) -> DataFrame:
    """Unpivot recordings into texts to extract: (keys, condition, view, text).

    records (model, item_id, condition, wants_audio, text, asr1, asr2, asr3) with completed transcripts.
    Text conditions give their text; speech gives the plan (if not empty), the primary transcript and
    the second and third view where completed.
    """
    primary = F.coalesce("asr1", "asr2")
    rows = F.array(
        F.struct(F.lit("text").alias("view"), F.when(~F.col("wants_audio"), F.col("text")).alias("t")),
        F.struct(F.lit("internal").alias("view"), F.when(F.col("wants_audio") & (F.col("text") != ""), F.col("text")).alias("t")),
        F.struct(F.lit("asr1").alias("view"), F.when(F.col("wants_audio"), primary).alias("t")),
        F.struct(F.lit("asr2").alias("view"), F.when(F.col("wants_audio"), F.col("asr2")).alias("t")),
        F.struct(F.lit("asr3").alias("view"), F.when(F.col("wants_audio"), F.col("asr3")).alias("t")),
    )
    keep = F.filter(rows, lambda r: r["t"].isNotNull())
    return records.select("model", "item_id", "condition", F.explode(keep).alias("r")).select(
        "model", "item_id", "condition", "r.view", F.col("r.t").alias("text"), text_hash("r.t").alias("text_hash"))


def merge_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Disjoint shards as one table; a missing path fails in the reader, a repeated key raises."""
    from factrail.operators.merging import unique_keys

    df = read_json(spark, paths, dims.EXTRACTIONS).where("_corrupt_record IS NULL").drop("_corrupt_record")
    return unique_keys(df, ["item_id", "condition"])


def without_shards(df: DataFrame) -> DataFrame:
    """Rows that do not come from a partial shard file."""
    return df.where(~F.col("_metadata.file_name").rlike(SHARD_FILE))


def numbered_lines(spark: SparkSession, path: str | list[str], separator: str = "\n") -> DataFrame:
    """(file, line, value) of text files: lines numbered from 1 over all files in the order of their names, however many
    splits a file is read in.

    Lines are counted per split, whose start is known; running totals of the counts give each split its first number, and
    a line's place in its split is the distance of its label from the split's first. Lines are never sorted or gathered.
    An empty file has no lines; a last line needs no separator.
    """
    from factrail.operators.ranking import running_totals

    rows = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    splits = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    placed = running_totals(splits, [], ["file", "split"], "n")
    return rows.join(placed, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")
