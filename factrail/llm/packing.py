"""Packs token sequences of documents into as few sequences of a fixed capacity as best fit finds.

Pieces above one third of the capacity pair at most twice per bin: greedy matching gives each, from the largest down, the
largest partner that fits beside it, which is the most pairs possible. Smaller pieces, from the largest down, go to the
fullest bin that still has room, and open a bin where none has.

Both steps depend on lengths only, and lengths are at most the capacity, so the plan is made on the histogram of lengths:
at most `capacity` counts reach the driver, whatever the number of documents. Bins with equal contents are planned as one
group with a count. A piece finds its bin by its rank among the pieces of its length: ranks are counted per shard and added
up per length, so a length that a third of all pieces share is no single task.

Cases: null text counts as empty and gives a piece with the end id alone; only documents longer than the capacity are cut,
their first piece being the shorter one; rows that repeat are packed each on their own; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factrail.llm.blocks import batches_of
from factrail.llm.common import materialise
from factrail.llm.tokens import default_vocabulary, encoded

CAPACITY = 1024
END_ID = 2
SHARD_ROWS = 50_000
PIECES_DDL = "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint, ids array<int>"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _cut(query: str, vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, batch, ids, bounds in encoded(batches, 1, query, vocabulary, end_id):
            n = np.diff(bounds)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = n - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            at = bounds[:-1][row] + start
            raw = ids.astype("<u4", copy=False)
            sums = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids, pa.int32())) if with_ids else pa.nulls(len(row), pa.list_(pa.int32()))
            yield batches_of(_PIECES, (batch.column(0).slice(lo, len(n)).take(pa.array(row)), piece, start, length, sums, lists))

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = rows.mapInArrow(_cut(uuid.uuid4().hex, vocabulary or default_vocabulary(), end_id, capacity, with_ids), PIECES_DDL)
    return out if with_ids else out.drop("ids")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first bin, pieces of it per bin, offset): where the pieces of a length go.

    A group is a run of equal bins: (first bin, number of bins). `room` maps free space to groups.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    bins = 0

    def place(length: int, first: int, number: int, per: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + number * per, first, per, offset))
        used[length] += number * per
        left[length] -= number * per

    def leave(space: int, first: int, number: int) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(spaces, space)
        room[space].append((first, number))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if left[a] == 0:
            large.pop()
            continue
        if at >= 0 and left[large[at]] == 0:
            large.pop(at)
            continue
        b = large[at] if at >= 0 else None
        if b is None or (b == a and left[a] == 1):
            if b == a and at > 0:
                large_b = large[at - 1]
                if left[large_b] == 0:
                    large.pop(at - 1)
                    continue
                b = large_b
            else:
                place(a, bins, left[a], 1, 0)
                n = rows[-1][2] - rows[-1][1]
                leave(capacity - a, bins, n)
                bins += n
                continue
        n = left[a] // 2 if a == b else min(left[a], left[b])
        place(a, bins, n, 1, 0)
        place(b, bins, n, 1, a)
        leave(capacity - a - b, bins, n)
        bins += n

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                per = capacity // length
                number = max(left[length] // per, 1)
                first, space = bins, capacity
                bins += number
            else:
                space = spaces[at]
                first, number = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
                per = space // length
            whole = min(number, left[length] // per)
            if whole:
                place(length, first, whole, per, capacity - space)
                leave(space - per * length, first, whole)
            elif left[length]:
                per, whole = left[length], 1
                place(length, first, 1, per, capacity - space)
                leave(space - per * length, first, 1)
            if number > whole:
                leave(space, first + whole, number - whole)
    return rows


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32 and any others)."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_bins(counts, capacity)
    plan = spark.createDataFrame([tuple(map(int, r)) for r in rows], "length bigint, rank_from bigint, rank_to bigint, bin bigint, per bigint, place bigint")
    # one row for each stretch of ranks; their number depends on the capacity, not on the number of pieces
    stretches = F.broadcast(plan)
    shards = max(1, sum(counts.values()) // SHARD_ROWS)
    sharded = pieces.withColumn("shard_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    totals = sharded.groupBy("length", "shard_").agg(F.count("*").alias("n_"))
    first = totals.select("length", "shard_", (F.sum("n_").over(Window.partitionBy("length").orderBy("shard_")) - F.col("n_")).alias("first_"))
    inside = F.row_number().over(Window.partitionBy("length", "shard_").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = sharded.withColumn("inside_", inside).join(first, ["length", "shard_"]).withColumn("rank_", F.col("first_") + F.col("inside_"))
    rank = F.col("rank_") - F.col("rank_from")
    return (ranked.join(stretches, "length").where((F.col("rank_") >= F.col("rank_from")) & (F.col("rank_") < F.col("rank_to")))
            .withColumn("sequence_id", F.col("bin") + F.floor(rank / F.col("per")))
            .withColumn("offset", F.col("place") + rank % F.col("per") * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def packed_sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, piece after piece; packed_pieces must carry ids. A sequence has at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; the ids themselves do not travel."""
    return packed(materialise(token_pieces(docs, capacity, vocabulary, end_id, with_ids=False)), capacity)
