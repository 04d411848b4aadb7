"""Token ids as Parquet list columns, and selective reads of them.

Files hold doc_id, n_tokens and ids (with the end id) in ascending doc_id order, file by file. Ids are dictionary-encoded:
the vocabulary fits in a dictionary page, so an id takes about two bytes; doc_id and n_tokens are delta-encoded by the
version-2 writer. Row groups and pages have set sizes, and page indexes let a reader skip pages by doc_id; lengths can be
read without touching ids.

Cases: null text counts as empty and gives the end id alone; rows that repeat an id stay apart, in the order of their text;
a null id sorts first; an empty table gives an empty file set. Long texts are never cut.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factrail.llm.blocks import batches_of
from factrail.llm.common import checkpoint_dir, parallelism, positions
from factrail.llm.tokens import default_vocabulary, encoded

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
ROWS_DDL = "doc_id bigint, n_tokens bigint, ids array<int>"


def _token_rows(query: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, batch, ids, bounds in encoded(batches, 1, query, vocabulary, end_id):
            rows = len(bounds) - 1
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            yield batches_of(_ROWS, (batch.column(0).slice(lo, rows), np.diff(bounds), lists))

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes them to path in ascending doc_id order."""
    files = files or parallelism(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = rows.mapInArrow(_token_rows(uuid.uuid4().hex, vocabulary or default_vocabulary(), end_id), ROWS_DDL)
    (tokens.write.option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows of the files, or those of a doc_id range (pushed down to row groups and pages)."""
    rows = spark.read.schema(ROWS_DDL).parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens only; the ids are not read."""
    return spark.read.schema("doc_id bigint, n_tokens bigint").parquet(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("row", pa.int64())])
    for batch in batches:
        lists = batch.column(2)
        bounds = lists.offsets.to_numpy(zero_copy_only=False)
        raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield batches_of(schema, (batch.column(0), batch.column(1), sums, batch.column(3), batch.column(4)))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens, ids_crc32, read back from the files."""
    rows = read_tokens(spark, path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sums = rows.mapInArrow(_sums, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, row bigint")
    return positions(sums, F.col("doc_id").asc_nulls_first(), "file", "row", weight=F.col("n_tokens")).select(
        "doc_id", F.col("before_").alias("start"), "n_tokens", "ids_crc32")


def scratch_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
