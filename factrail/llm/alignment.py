"""Tokens of two tokenizers over the same bytes: groups, overlapping pairs and how often a pair overlaps in the corpus.

Interval coalescing on whole blocks of documents: the byte intervals of all tokens of both sides are lexsorted by start, a
running maximum of their ends is taken (maximum.accumulate), and a group breaks where a start reaches it; inside, every
token meets the run of tokens of the other side that it overlaps. Documents follow one another without a gap, so their ends
are breaks too.

Pairs are counted over the corpus from the written links (pre-aggregated per task). To bring the counts back to the
documents, the frequent pairs are broadcast, at most HEAD of them by a threshold read off a histogram of at most 64 counts;
the pairs below it have no hot keys and join by an ordinary shuffle. Every pair is counted and found, whatever the number.

Cases: a text that is null or empty, or that one of the tokenizers doesn't reproduce byte for byte behind one space, has
no tokens: counts of zero and an empty digest. Strings of special tokens in a text are plain text. Rows that repeat an id
or have none stay rows of their own. Whole texts, of any length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factrail.llm.blocks import batches_of, text_blocks
from factrail.llm.common import materialise, stored
from factrail.llm.tokens import Encoder, byte_entries, default_vocabulary

#: Pairs that are broadcast at most (16 MB of keys and counts).
HEAD = 1 << 20
#: Chunks that a worker remembers, and the size of the row groups it writes: both only bound its memory.
SLOTS = 1 << 20
ROW_GROUP_BYTES = 16 << 20
ROWS_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64()))])


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Entries:
    """The bytes of every id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        before = np.concatenate(([0], np.cumsum(n)))
        return self.pool[np.repeat(self.first[ids] - before[:-1], n) + np.arange(int(before[-1]))]


class Pieces:
    """Ids and bytes of a sentencepiece model; one per worker and query."""

    current: tuple[str, Pieces] | None = None

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.entries = Entries([bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    @classmethod
    def of(cls, query: str, model: str) -> Pieces:
        if cls.current is None or cls.current[0] != query:
            cls.current = (query, cls(model))
        return cls.current[1]

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return (np.concatenate([np.asarray(i, np.int64) for i in ids]) if len(ids) else np.zeros(0, np.int64)), counts


def reproduced(entries: Entries, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which rows of a block the joined bytes of their tokens equal."""
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    size = np.bincount(row, weights=entries.length[ids], minlength=rows).astype(np.int64)
    good = size == np.diff(offsets)
    made = entries.joined(ids[good[row]])
    here = np.repeat(good, np.diff(offsets))
    wrong = np.flatnonzero(made != data[here])
    good[(np.repeat(np.arange(rows), np.diff(offsets))[here])[wrong]] = False
    return good


def coalesced(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): all intervals of a, then of b, by start (a first), and the number of the group of each in that order."""
    start, end = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    side = np.repeat([0, 1], [len(a[0]), len(b[0])])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate(([True], start[order][1:] >= reach[:-1])) if len(order) else np.zeros(0, bool)
    return order, np.cumsum(breaks) - 1


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of a, token of b) whose intervals overlap; each side is disjoint and ascending."""
    first = np.searchsorted(b[1], a[0], side="right")
    last = np.searchsorted(b[0], a[1], side="left")
    n = np.maximum(last - first, 0)
    before = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(np.arange(len(n)), n), np.repeat(first - before[:-1], n) + np.arange(int(before[-1]))


def _spans(entries: Entries, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(entries.length[ids])
    return end - entries.length[ids], end


def _described(ids: np.ndarray, sides: np.ndarray, group: np.ndarray, row: np.ndarray, rows: int) -> list[str]:
    """sha256 of 'a1,a2|b1;...' per row; tokens come group by group, side a first. Empty for a row without tokens."""
    n = len(ids)
    if not n:
        return [""] * rows
    names = np.array([str(i) for i in range(int(ids.max()) + 1)], object)
    end_group = np.append(group[1:] != group[:-1], True)
    end_row = np.append(row[1:] != row[:-1], True)
    turn = np.append(sides[1:] != sides[:-1], True)
    mark = np.array([",", "|", ";", ""], object)[np.where(end_row, 3, np.where(end_group, 2, np.where(turn, 1, 0)))]
    parts = np.empty(2 * n, object)
    parts[0::2], parts[1::2] = names[ids], mark
    bounds = 2 * np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
    texts = ("".join(parts[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]


def _aligned(query: str, vocabulary: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = Encoder.of(query, vocabulary, plain=True, slots=SLOTS), Pieces.of(query, model)
        left, right = Entries(byte_entries(encoder.tokenizer)), pieces.entries
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.large_string()), text)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
            for lo, offsets, data in text_blocks(spaced):
                rows = len(offsets) - 1
                a_ids, a_n = encoder.block(offsets, data)
                b_ids, b_n = pieces.block([t or "" for t in text.slice(lo, rows).to_pylist()])
                a_ids = a_ids.astype(np.int64)
                good = reproduced(left, a_ids, a_n, offsets, data) & reproduced(right, b_ids, b_n, offsets, data)
                a_ids, a_n = a_ids[np.repeat(good, a_n)], np.where(good, a_n, 0)
                b_ids, b_n = b_ids[np.repeat(good, b_n)], np.where(good, b_n, 0)
                a_row, b_row = np.repeat(np.arange(rows), a_n), np.repeat(np.arange(rows), b_n)
                a, b = _spans(left, a_ids), _spans(right, b_ids)
                order, group = coalesced(a, b)
                side = (order >= len(a_ids)).astype(np.int64)
                grouped = np.lexsort((side, group))  # stable: by start inside a side
                ids, row = np.concatenate((a_ids, b_ids))[order][grouped], np.concatenate((a_row, b_row))[order][grouped]
                x, y = overlaps(a, b)
                keys = (a_ids[x] << 32) | b_ids[y]
                per_row = np.bincount(a_row[x], minlength=rows)
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)), pa.array(keys))
                yield batches_of(_ROWS, (batch.column(0).slice(lo, rows), a_n, b_n, np.bincount(row[heads], minlength=rows), per_row,
                                         _described(ids, side[grouped], group[grouped], row, rows), lists))

    return run


def aligned(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): numbers of tokens, groups and links, the digest of the groups, and the links themselves
    (id of A in the upper 32 bits, id of B in the lower)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_aligned(uuid.uuid4().hex, vocabulary or default_vocabulary(), model or default_pieces()), ROWS_DDL)


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n, best): how many links hold a pair of ids, and whether no pair of the same B id is in more."""
    counts = materialise(links.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    b = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def threshold(pairs: DataFrame, head: int = HEAD) -> int:
    """The least power of two that at most ``head`` pairs reach."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["pairs"] for r in pairs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    reached, least = 0, max(sizes, default=0) + 1
    for at in range(least - 1, -1, -1):
        reached += sizes.get(at, 0)
        if reached > head:
            break
        least = at
    return 1 << least


def alignment(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(aligned(docs, vocabulary, model).withColumn("row_", F.monotonically_increasing_id()), {"parquet.block.size": ROW_GROUP_BYTES})
    links = rows.select("row_", F.explode("links").alias("key"))
    pairs = materialise(pair_counts(links))
    least = threshold(pairs, head)
    sums = [F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("bigint")).alias("n_best")]
    found = links.join(F.broadcast(pairs.where(F.col("n") >= least)), "key", "left")
    totals = found.where("n IS NOT NULL").groupBy("row_").agg(*sums)
    if least > 1:
        rare = found.where("n IS NULL").select("row_", "key").join(pairs.where(F.col("n") < least), "key")
        totals = totals.unionByName(rare.groupBy("row_").agg(*sums)).groupBy("row_").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("bigint")
    return rows.drop("links").join(totals, "row_", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
