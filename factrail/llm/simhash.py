"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits through an index of byte positions.

A fingerprint bit is set when it is set in over half of the shingles' hashes. Two fingerprints of eight bytes that differ in
at most four bits share at least four positional bytes, so they meet in a list of the inverted index; an entry of the
index is a choice of four positions with the bytes there (single bytes would make every list 1/256 of all). For a pair that
meets, the shared positional bytes are tallied, pairs below the guaranteed minimum go, a pair counts only in the first of its
lists, and what is left is verified on all 64 bits.

No list is expanded into all its pairs. Equal fingerprints are one node. Every list first links its members to its least
one; after those links are closed, only pairs of different components are looked for. Lists that still hold more than
DENSE members keep all links in another way: within a list 32 bits are free, and two members differ in at most four
of them exactly when some pattern lies within two bits of both. All members around a pattern are linked to the least of
them, which costs 529 rows a member, whatever the list.

Cases: null, empty and wordless texts have fingerprint zero and link like any other; fewer words than the width are one
shingle; repeated rows and ids share a fingerprint; rows without an id carry the least id of their component, or null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factrail.llm.common import components, materialise, parallelism, stored

WIDTH = 4
SEED = 42
BITS = 4
POSITIONS = 8
#: Positional bytes that two fingerprints within BITS bits share at least.
SHARED = POSITIONS - BITS
CHOICES = list(combinations(range(POSITIONS), SHARED))
#: Members from which 529 patterns a member are fewer than a list's pairs.
DENSE = 1058
#: A fingerprint with more than this share of the rows is joined by broadcast; there are at most HOT of them.
HOT = 1024
_SEPARATORS = re.compile(rb"[\x20\x09-\x0d]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed before their bits are counted.
RUN = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    line = _SEPARATORS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)).strip(b" ")
    if not line:
        return 0
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(line))
    if len(starts) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    view, counts = memoryview(line), np.zeros(64, np.int64)
    for i in range(0, len(starts), RUN):
        hashes = [xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[i : i + RUN].tolist(), ends[i : i + RUN].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


def _byte(fp: Column, at: int) -> Column:
    return F.shiftright(fp, 8 * at).bitwiseAND(F.lit(255))


def _shared(a: Column, b: Column) -> tuple[Column, Column]:
    """How many positional bytes two fingerprints share, and which: bit p of the second is set for a shared position p."""
    same = [(_byte(a, p) == _byte(b, p)).cast("int") for p in range(POSITIONS)]
    tally, which = same[0], same[0]
    for p in range(1, POSITIONS):
        tally, which = tally + same[p], which + F.shiftleft(same[p], p)
    return tally, which


def index_entries(nodes: DataFrame) -> DataFrame:
    """(choice, bytes, fp): every fingerprint under each choice of SHARED positions."""
    def entry(i: int, positions: tuple[int, ...]) -> Column:
        held = F.lit(0).cast("bigint")
        for k, p in enumerate(positions):
            held = held + F.shiftleft(_byte(F.col("fp"), p), 8 * k)
        return F.struct(F.lit(i).alias("choice"), held.alias("bytes"))

    return nodes.select("fp", F.explode(F.array(*[entry(i, c) for i, c in enumerate(CHOICES)])).alias("e")).select("e.choice", "e.bytes", "fp")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def _first_choice(which: Column) -> Column:
    """The first choice of positions that all lie among the shared ones."""
    table = [next((i for i, c in enumerate(CHOICES) if all(m >> p & 1 for p in c)), -1) for m in range(1 << POSITIONS)]
    return F.element_at(F.array(*[F.lit(i) for i in table]), which + 1)


def _free_patterns(choice: Column) -> Column:
    """The flips of at most BITS / 2 of the bits outside a choice's positions, as 64-bit masks."""
    single = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)])
    taken = F.element_at(F.array(*[F.lit(sum(255 << 8 * p for p in c) - (1 << 64 if 7 in c else 0)).cast("bigint") for c in CHOICES]), choice + 1)
    free = F.filter(single, lambda b: b.bitwiseAND(taken) == 0)
    pairs = F.flatten(F.transform(free, lambda b, i: F.transform(F.slice(free, i + 2, 64), lambda c: b.bitwiseOR(c))))
    return F.concat(F.array(F.lit(0).cast("bigint")), free, pairs)


def list_members(nodes: DataFrame) -> DataFrame:
    """(choice, bytes, fp, n, lead): the entries of lists with more than one member.

    Spark takes the lists for as small as the table of nodes, since an explode counts as one row, so every join of lists, members
    or fingerprints asks for a merge join: none of them is broadcast, whatever the estimate.
    """
    lists = index_entries(nodes).groupBy("choice", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lead")).where("n > 1")
    return index_entries(nodes).join(lists.hint("merge"), ["choice", "bytes"])


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect exactly what all links within BITS bits connect."""
    nodes = nodes.repartition(parallelism(nodes.sparkSession), "fp")
    members = stored(list_members(nodes))
    least = members.where((F.col("fp") != F.col("lead")) & _near(F.col("fp"), F.col("lead"))).select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct()
    least = materialise(least)
    comp = components(least).select(F.col("node").alias("fp"), "comp")
    known = members.join(comp.hint("merge"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    open_lists = known.groupBy("choice", "bytes").agg(F.count(F.lit(1)).alias("m"), (F.min("comp") != F.max("comp")).alias("open")).where("open").drop("open")
    rest = stored(known.select("choice", "bytes", "fp", "comp").join(open_lists.hint("merge"), ["choice", "bytes"]))
    few = rest.where(F.col("m") <= dense)
    a, b = few.select("choice", "bytes", "fp", "comp"), few.select("choice", "bytes", F.col("fp").alias("other"), F.col("comp").alias("there"))
    tally, which = _shared(F.col("fp"), F.col("other"))
    pairs = a.join(b.hint("merge"), ["choice", "bytes"]).where(
        (F.col("comp") < F.col("there")) & (tally >= SHARED) & (F.col("choice") == _first_choice(which)) & _near(F.col("fp"), F.col("other")))
    around = rest.where(F.col("m") > dense).select("choice", "bytes", "fp", F.explode(_free_patterns(F.col("choice"))).alias("flip"))
    around = around.select("choice", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("pattern"))
    center = F.min("fp").over(W.partitionBy("choice", "pattern"))
    dense_links = around.withColumn("b", center).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return least.unionByName(pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))).unionByName(dense_links)


def simhash_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the least doc_id that links reach."""
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint"))
    nodes = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    comp = materialise(components(materialise(links(nodes.select("fp")))).select(F.col("node").alias("fp"), "comp"))
    least = nodes.join(comp.hint("merge"), "fp").groupBy("comp").agg(F.min("first").alias("component_id"))
    reached = comp.join(least.hint("merge"), "comp").select("fp", "component_id")
    named = materialise(nodes.join(reached.hint("merge"), "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    total = rows.count()
    hot = named.where(F.col("n") * HOT > total).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), "fp", "left")
    often = marked.where("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    seldom = marked.where("is_hot IS NULL").select("doc_id", "fp").join(
        named.where(F.col("n") * HOT <= total).select("fp", "component_id").hint("merge"), "fp")
    return often.unionByName(seldom).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
