"""A keyed table in hash buckets: an upsert rewrites the buckets that its keys fall into and leaves all others alone.

Below ``root`` every version has a folder of data with the buckets it wrote, and a manifest (one row per bucket: which version
holds it) that is written as a snapshot, after the data. Readers take the newest listed manifest, so a half-written version
is never read and older versions stay readable until they expire. A version that is written again starts from the
same predecessor, so a replay gives the same table. One writer at a time.

The number of buckets is chosen with the first version and kept; it should make a bucket a few files. NULL keys are keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from factrail.sources.writers import latest_version, write_snapshot

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]
BUCKETS = 64


def _manifest(spark: SparkSession, root: str, version: int | None) -> tuple[dict[int, int], int | None]:
    """The version that holds each bucket, and the number of buckets (one row a bucket comes to the driver)."""
    if version is None:
        return {}, None
    rows = spark.read.parquet(f"{root}/v={version:09d}").collect()
    return {r.bucket: r.version for r in rows if r.version is not None}, rows[0].buckets if rows else None


def _paths(root: str, held: dict[int, int]) -> list[str]:
    return [f"{root}/data/v={v:09d}/bucket={b}" for b, v in sorted(held.items())]


def upsert_table(batch: DataFrame, root: str, version: int, keys: Sequence[str], merge: Merge, *, buckets: int = BUCKETS) -> None:
    """Writes ``version``: merge(old rows or None, new rows) of the touched buckets, all other buckets as they were.

    ``merge`` must keep every row in the bucket of its keys and may drop rows.
    """
    spark = batch.sparkSession
    held, known = _manifest(spark, root, latest_version(spark, root, before=version))
    buckets = known or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = {r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()}
    old = _paths(root, {b: v for b, v in held.items() if b in touched})
    merged = merge(spark.read.parquet(*old) if old else None, batch).withColumn("bucket", bucket)
    data = f"{root}/data/v={version:09d}"
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    written = {r.bucket for r in spark.read.parquet(data).select("bucket").distinct().collect()} if touched else set()
    now = {b: v for b, v in held.items() if b not in touched} | {b: version for b in written}
    rows = [(b, now.get(b), buckets) for b in range(buckets)]
    write_snapshot(spark.createDataFrame(rows, "bucket int, version bigint, buckets int").coalesce(1), root, version, mode="overwrite")


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the one named; only its files are read."""
    version = latest_version(spark, root) if version is None else version
    held, _ = _manifest(spark, root, version)
    if not held:
        raise FileNotFoundError(f"no rows in a table under {root}")
    return spark.read.parquet(*_paths(root, held))


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the bucket folders that none of the newest ``keep`` versions holds, and the manifests before them; returns how
    many folders went."""
    listed = sorted(r.version for r in spark.read.schema("version bigint, n string").parquet(f"{root}/complete").select("version").collect())
    kept, gone = listed[-keep:], listed[:-keep]
    needed = {p for v in kept for p in _paths(root, _manifest(spark, root, v)[0])}
    old = {p for v in gone for p in _paths(root, _manifest(spark, root, v)[0])} - needed
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    # the list entry first: a version that is no longer listed is not read
    for p in [*[f"{root}/complete/n={v:09d}" for v in gone], *[f"{root}/v={v:09d}" for v in gone], *sorted(old)]:
        files.delete(path(p), True)
    return len(old)
