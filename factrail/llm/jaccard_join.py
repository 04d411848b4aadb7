"""Exact self-join of texts by the Jaccard similarity of their word n-gram sets; returns the classes that its links form.

Size-aware heavy-light join. Sets are ordered by how many other sets hold each shingle. Small sets enumerate the
two-element subsets of their prefix (two linked sets share at least two of their rarest shingles); large sets scan inverted
lists of single prefix shingles. The boundary is the set size at which the summed cost of both parts is least, measured
on the data. Every candidate is checked exactly.

What makes it cheap: a link needs most of a set's shingles to occur in some other set. A sample of the hash space,
the same for all sets that can link, gives an exact bound on that; sets that fail it take no further part. Equal sets are
one node. Lists are never expanded into all pairs: a list is first compared with its most central member, and after
the found links are closed only pairs between different components are left.

Cases: null or wordless texts have no shingles and link with nothing; texts with fewer words than the width have their
whole sequence as the only shingle; repeated rows share a class; rows without an id return a null component and link
with nothing. Shingles are 52-bit hashes, sets are known by 64-bit digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factrail.llm.blocks import HASH_BITS, batches_of, mix, row_sums, shingle_sets, text_blocks
from factrail.llm.common import components, gathered, materialise, parallelism, stored

#: Sets up to this size are compared on all shingles, larger ones on this share of the hash space in the first filter.
WHOLE = 64
SAMPLE = 3 / 8
#: Shingle entries that one task of the filters and of the list building holds (about 24 bytes each).
ENTRIES = 1_500_000
#: Bits of the signature that rules pairs out before their sets are fetched.
BITS = 1024
#: What an enumerated subset (a row that is shuffled) costs, in scanned list entries (comparisons).
SUBSET_COST = 16
#: Pairs tested at once, per entry of the lists.
PAIRS_PER_ENTRY = 64
#: Earlier lists of a member that travel with each of its entries, so that a pair which met in one of them is not made again.
EARLIER = 8
#: Bits of the map of sets that are left, per set, and the bits that one row of it holds (a fixed size of Spark's bitmaps).
MAP_BITS = 16
ROW_BITS = 32768
#: Rows of that map which are broadcast at most (4 KB each); with more, all texts go through the shuffle.
MAP_ROWS = 16384


def _limit(n: np.ndarray) -> np.ndarray:
    """Hash limit below which a set of size n takes part in the sample; never rises with n."""
    return np.where(n <= WHOLE, np.uint64(1 << HASH_BITS), np.uint64(int(SAMPLE * (1 << HASH_BITS))))


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of size n must share with any partner."""
    return -(-percent * n // 100)


def _digest(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    return mix(row_sums(mix(value + np.uint64(0x1234567)), doc, rows)).view(np.int64)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sampled", pa.int64())])


def _describe(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, offsets, data in text_blocks(batch.column(1)):
                doc, value, n = shingle_sets(offsets, data, width)
                seen = value < _limit(n * 100 // percent)[doc]
                ids = batch.column(0).slice(lo, len(n))
                yield batches_of(_SETS, (ids, n, _digest(doc, value, len(n)), np.bincount(doc[seen], minlength=len(n))))

    return run


_ENTRIES = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("hashes", pa.binary())])
_ENTRIES_DDL = "part int, nodes binary, hashes binary"


def _split(part: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row per part that occurs; columns are packed 64-bit integers."""
    order = np.argsort(part, kind="stable")
    part, nodes, values = part[order], nodes[order], values[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(part))
    return batches_of(_ENTRIES, (part[cut].astype(np.int32), [nodes[a:b].tobytes() for a, b in zip(cut, ends)], [values[a:b].tobytes() for a, b in zip(cut, ends)]))


def _part(value: np.ndarray, parts: int) -> np.ndarray:
    return ((value & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sampled_entries(parts: int, percent: int, width: int):
    """Sampled shingles by hash. A set judges itself only on the range that all its possible partners put into the sample;
    beyond it the entry carries the complement of the set's digest. A shingle that several sets of a block hold is known to be shared: those sets keep
    a count (in parts beyond the last) and one entry without a set travels, so a frequent shingle costs a block one entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, offsets, data in text_blocks(batch.column(0)):
                doc, value, n = shingle_sets(offsets, data, width)
                node = _digest(doc, value, len(n))
                _, one = np.unique(node, return_index=True)
                first = np.zeros(len(n), bool)
                first[one] = True
                keep = (value < _limit(n)[doc]) & first[doc]
                doc, value = doc[keep], value[keep]
                order = np.argsort(value, kind="stable")
                doc, value = doc[order], value[order]
                head = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
                group = np.cumsum(head) - 1
                shared = np.bincount(group)[group] > 1 if len(value) else head
                travels = ~shared | head
                own = value < _limit(n * 100 // percent)[doc]
                nodes = np.where(shared, 0, np.where(own, node[doc], ~node[doc]))[travels]
                yield _split(_part(value[travels], parts), nodes, value[travels].view(np.int64))
                counted = doc[shared & own]
                held = np.bincount(counted, minlength=len(n))
                at = np.flatnonzero(held)
                yield _split(parts + (node[at] % parts), node[at], held[at])

    return run


def _unpack(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in names]


def _shared_counts(parts: int):
    """Per set: how many of its shingles in this part some other set holds too."""
    schema = pa.schema([("node", pa.int64()), ("shared", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes, values = _unpack(table, "nodes", "hashes")
        if key[0].as_py() >= parts:
            node, at = np.unique(nodes, return_inverse=True)
            return pa.table([node, np.bincount(at, weights=values, minlength=len(node)).astype(np.int64)], schema=schema)
        order = np.lexsort((nodes, values))
        nodes, values = nodes[order], values[order]
        head = np.concatenate(([True], values[1:] != values[:-1]))
        group = np.cumsum(head) - 1
        other = np.concatenate(([True], (nodes[1:] != nodes[:-1]) | head[1:]))
        several = np.bincount(group, weights=other) + np.bincount(group, weights=nodes == 0) > 1
        hit = several[group] & other & (nodes != 0)
        node, shared = np.unique(nodes[hit], return_counts=True)
        return pa.table([node, shared], schema=schema)

    return run




def _whole_entries(parts: int, width: int):
    """All shingles of the sets that are left, by hash range; the set size travels with each run of a set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, offsets, data in text_blocks(batch.column(1)):
                doc, value, n = shingle_sets(offsets, data, width)
                node = _digest(doc, value, len(n))
                wanted = node == batch.column(0).slice(lo, len(n)).to_numpy(zero_copy_only=False)
                keep = wanted[doc]
                doc, value = doc[keep], value[keep]
                yield _split(_part(value, parts), node[doc], value.view(np.int64))

    return run


def _frequencies(parts: int):
    """Entries whose shingle several sets hold, with that number, dealt out by set."""
    schema = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        nodes, values = _unpack(table, "nodes", "hashes")
        order = np.lexsort((nodes, values))
        nodes, values = nodes[order], values[order]
        keep = np.concatenate(([True], (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1])))
        nodes, values = nodes[keep], values[keep]
        group = np.cumsum(np.concatenate(([True], values[1:] != values[:-1]))) - 1
        held = np.bincount(group)[group]
        keep = held > 1
        nodes, values, held = nodes[keep], values[keep], held[keep]
        part = nodes % parts
        order = np.lexsort((nodes, part))
        nodes, values, held, part = nodes[order], values[order], held[order], part[order]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(part))
        pack = lambda x: [x[a:b].tobytes() for a, b in zip(cut, ends)]
        return pa.table([pa.array(part[cut].astype(np.int32)), pa.array(pack(nodes), pa.binary()), pa.array(pack(values), pa.binary()), pa.array(pack(held), pa.binary())], schema=schema)

    return run




def _ordered():
    """Each set's shared shingles, rarest first (ties by hash), with the comparisons that scanning their lists up to each
    place costs (a member meets no more than PAIRS_PER_ENTRY others at once), and a bit for each residue that they leave."""
    schema = pa.schema([("node", pa.int64()), ("held", pa.list_(pa.int64())), ("reach", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        nodes, values, held = _unpack(table, "nodes", "hashes", "counts")
        order = np.lexsort((values, held, nodes))
        nodes, values, held = nodes[order], values[order], held[order]
        cut = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if len(nodes) else np.zeros(0, np.int64)
        ends = np.append(cut, len(nodes)).astype(np.int32)
        total = np.cumsum(np.minimum(held, PAIRS_PER_ENTRY))
        reach = total - np.repeat(np.concatenate(([0], total))[cut], np.diff(ends))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))
        bits = np.zeros((len(cut), BITS // 8), np.uint8)
        bit = values % BITS
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(cut)), np.diff(ends)), bit // 8), (1 << (bit % 8)).astype(np.uint8))
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1) * (BITS // 64), pa.int32()), pa.array(bits.reshape(-1).view(np.int64), pa.int64()))
        return pa.table([pa.array(nodes[cut], pa.int64()), lists(values), lists(reach), words], schema=schema)

    return run


def _boundary(sets: DataFrame) -> int:
    """Largest size that enumerates subsets: the cut at which enumerated subsets plus scanned list entries are fewest."""
    size = F.least("n", F.lit(1024))
    rows = sets.groupBy(size.alias("n")).agg(F.sum(F.col("p2") * (F.col("p2") - 1) / 2).alias("subsets"), F.sum("scan").alias("scans")).orderBy("n").collect()
    best, cost = 0, sum(r.scans for r in rows)
    least, now = cost, cost
    for r in rows[:-1] if rows and rows[-1].n == 1024 else rows:
        now += SUBSET_COST * float(r.subsets) - r.scans
        if now < least:
            best, least = r.n, now
    return best


def _missing(a, b):
    """Bits of a that b lacks: so many shingles of a's set, at least, are not in b's."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) with an exact verdict, and bounds of their Jaccard distance. Signatures rule out most of those
    that do not link; sets are fetched for the others."""
    need = percent * (F.col("nx") + F.col("ny")) / (100 + percent) - 1e-6
    sized = lambda node, held, n: sets.select(F.col("node").alias(node), F.col("held").alias(held), F.col("n").alias(n))
    brief = sets.select("node", "n", F.size("held").alias("size"), "bits")
    one = brief.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("size").alias("sx"), F.col("bits").alias("x"))
    two = brief.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("size").alias("sy"), F.col("bits").alias("y"))
    most = F.least(F.col("sx") - _missing(F.col("x"), F.col("y")), F.col("sy") - _missing(F.col("y"), F.col("x")))
    apart = lambda shared: 1 - shared / (F.col("nx") + F.col("ny") - shared)
    pairs = materialise(pairs)
    rows = pairs.count()
    judged = materialise(gathered(gathered(pairs, rows).join(one, "a").join(two, "b").select("a", "b", (most >= need).alias("able"), apart(most).alias("near")), rows))
    both = F.size(F.array_intersect("x", "y"))
    exact = judged.where("able").join(sized("a", "x", "nx"), "a").join(sized("b", "y", "ny"), "b").select(
        "a", "b", (both * 100 >= percent * (F.col("nx") + F.col("ny") - both)).alias("linked"), apart(both).alias("near"), apart(both).alias("far"))
    return materialise(judged.where("not able").select("a", "b", F.lit(False).alias("linked"), "near", F.lit(1.0).alias("far")).unionByName(gathered(exact, rows)))


def _possible(percent: int):
    """Whether two members of a list can link: by their sizes, by how many shared shingles lie before and after the key, and by
    their distances to the member that led the list first (Jaccard distance is a metric)."""
    need = percent * (F.col("n") + F.col("n_")) / (100 + percent)
    most = F.least("at", "at_") + F.least(F.col("held") - F.col("at"), F.col("held_") - F.col("at_"))
    return (F.col("n") * 100 >= F.col("n_") * percent) & (F.col("n_") * 100 >= F.col("n") * percent) & (most >= need - 1e-6) & (
        F.greatest(F.col("near") - F.col("far_"), F.col("near_") - F.col("far")) <= 1 - percent / 100 + 1e-9)


def _mapped(docs: DataFrame, alive: DataFrame, count: int) -> DataFrame:
    """The rows of docs whose id may be among alive (first): all that are, and about one in MAP_BITS others. The map is made
    by one aggregation and its size follows from the count; where it would exceed MAP_ROWS, docs is returned as it is."""
    buckets = -(-count * MAP_BITS // ROW_BITS)
    if not 0 < buckets <= MAP_ROWS:
        return docs
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets * ROW_BITS))
    bits = alive.select(place("first").alias("spot")).groupBy(F.floor(F.col("spot") / ROW_BITS).alias("bucket_")).agg(
        F.bitmap_construct_agg(F.pmod("spot", F.lit(ROW_BITS))).alias("map_"))
    spot = F.pmod(F.col("spot_"), F.lit(ROW_BITS)).cast("int")
    octet = F.conv(F.hex(F.substring("map_", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("spot_", place("doc_id")).withColumn("bucket_", F.floor(F.col("spot_") / ROW_BITS))
    held = F.pmod(F.floor(octet / F.pow(F.lit(2), F.pmod(spot, F.lit(8)))), F.lit(2)) == 1
    return marked.join(F.broadcast(bits), "bucket_").where(held).select(*docs.columns)


def _linked_components(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) of linked nodes, from the lists (key; node, n, held, at)."""
    member = ["node", "n", "held", "at", "near", "far"]
    entries = entries.withColumns({"near": F.lit(0.0), "far": F.lit(1.0)})
    other = [F.col("node").alias("other"), F.col("n").alias("n_"), F.col("held").alias("held_"), F.col("at").alias("at_"), F.col("near").alias("near_"), F.col("far").alias("far_"), F.col("comp").alias("there")]
    members = [F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")]
    fits = _possible(percent)
    label, edges, done = None, None, None
    turn, rows = 0, entries.count()
    while True:
        now = entries.withColumn("comp", F.col("node")) if label is None else (
            entries.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        # the most central member, with the fewest shingles of its own, leads
        loose = (F.col("n") - F.col("held")) / F.col("n")
        if label is None:
            lists = now.groupBy("key").agg(F.count("*").alias("m"), F.min_by("node", loose).alias("lead"), *members).where("m > 1").withColumn("cross", F.lit(0.0))
        else:
            per = now.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by("node", loose).alias("lead"), F.min(loose).alias("loose"), *members)
            lists = per.groupBy("key").agg(
                F.count("*").alias("kinds"), F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("own"), F.min_by("lead", "loose").alias("lead"),
                F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
            lists = lists.where("kinds > 1").withColumn("cross", (F.col("m").cast("double") * F.col("m") - F.col("own")) / 2)
        # shingles of one passage have lists with the same members: one of them is enough
        lists = lists.groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.first("cross").alias("cross"), F.min("lead").alias("lead"))
        live = now.join(lists.select("key", "m", "cross", "lead"), "key")
        live = materialise(gathered(live, rows))
        rows = live.count()
        if not rows:
            break
        light = (F.col("cross") <= PAIRS_PER_ENTRY * F.col("m")) & F.lit(turn > 0)
        # from the second turn on ever more members lead a long list
        first = (F.col("node") == F.col("lead")) | (F.lit(turn > 0) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.col("m")) < F.lit(16 ** turn)))
        live = live.withColumns({"light": light, "leads": first})
        fresh = F.lit(True)
        if turn:
            # two members that share an earlier list of this turn, led by one of them if it is long, met there or cannot link
            before = Window.partitionBy("node", "light").orderBy("key").rowsBetween(-EARLIER, -1)
            live = materialise(live.withColumns({"met": F.collect_list("key").over(before), "led": F.collect_list(F.when(F.col("leads"), F.col("key"))).over(before)}))
            fresh = ~F.arrays_overlap("met", "met_")
        few, many = live.where("light"), live.where("not light")
        leads = many.where("leads")
        ordered = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
        seen = lambda c: [F.col(c).alias("met_")] if turn else []
        crossing = few.join(few.select("key", *other, *seen("met")), "key").where((F.col("comp") < F.col("there")) & fits & fresh).select(*ordered)
        against = many.join(leads.select("key", *other, *seen("led")), "key").where((F.col("comp") != F.col("there")) & fits & fresh).select(*ordered)
        pairs = gathered(gathered(crossing, rows).unionByName(gathered(against, rows)).distinct(), rows)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tested = _tested(pairs, sets, percent)
        done = tested.select("a", "b") if done is None else done.unionByName(tested.select("a", "b"))
        new = tested.where("linked").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        label = components(edges)
        edges = label.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        # a member that led has met its whole list; short lists are finished
        left = many.join(leads.select("key", "node"), ["key", "node"], "left_anti")
        if turn == 0:
            # every list had one lead; who was not tested against it could not link with it
            met = tested.select("a", "b", F.col("near").alias("near_"), F.col("far").alias("far_"))
            left = left.withColumns({"a": F.least("node", "lead"), "b": F.greatest("node", "lead")}).join(met, ["a", "b"], "left").withColumns(
                {"near": F.coalesce("near_", F.lit(1 - percent / 100)), "far": F.coalesce("far_", F.lit(1.0))})
        entries = materialise(gathered(left.select("key", *member), rows))
        turn += 1
    return label


def jaccard_classes(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row of docs (doc_id, text).

    Two rows link when 100 * shared >= percent * united distinct shingles.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialise(docs.mapInArrow(_describe(percent, width), "doc_id bigint, n_shingles bigint, node bigint, sampled bigint"))
    named = described.where("n_shingles > 0 and doc_id is not null")
    nodes = materialise(named.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.max("sampled").alias("sampled")))
    total = nodes.agg(F.coalesce(F.sum(F.when(F.col("n") <= WHOLE, F.col("n")).otherwise(F.col("n") * SAMPLE)), F.lit(0))).first()[0]
    parts = max(parallelism(spark), int(total / ENTRIES) + 1)

    counts = (docs.where("doc_id is not null").select("text").mapInArrow(_sampled_entries(parts, percent, width), _ENTRIES_DDL)
              .groupBy("part").applyInArrow(_shared_counts(parts), "node bigint, shared bigint"))
    shared = counts.groupBy("node").agg(F.sum("shared").alias("shared"))
    need = F.ceil(F.col("n") * percent / 100)
    seen = nodes.join(shared, "node", "left").fillna(0, ["shared"])
    alive = materialise(seen.where((F.col("n") > 2) & (F.col("shared") >= F.col("sampled") - (F.col("n") - need))).select("node", "first", "n"))

    left, count = alive.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(parallelism(spark), int(left / ENTRIES) + 1)
    rows = _mapped(docs, alive, count).join(alive.select(F.col("first").alias("doc_id"), "node"), "doc_id").select("node", "text")
    held = (rows.mapInArrow(_whole_entries(parts, width), _ENTRIES_DDL)
            .groupBy("part").applyInArrow(_frequencies(parts), "part int, nodes binary, hashes binary, counts binary")
            .groupBy("part").applyInArrow(_ordered(), "node bigint, held array<bigint>, reach array<bigint>, bits array<bigint>"))
    sets = held.join(alive.select("node", "n", "first"), "node")
    lone = F.col("n") - F.size("held")
    sets = (sets.withColumn("need", F.ceil(F.col("n") * percent / 100)).where(F.size("held") >= F.col("need"))
            .withColumn("p1", F.greatest(F.col("n") - F.col("need") + 1 - lone, F.lit(0)).cast("int"))
            .withColumn("p2", F.least(F.greatest(F.col("n") - F.col("need") + 2 - lone, F.lit(0)), F.size("held")).cast("int"))
            .withColumn("scan", F.when(F.col("p1") > 0, F.element_at("reach", F.greatest("p1", F.lit(1)))).otherwise(F.lit(0)))
            .select("node", "first", "n", "held", "bits", "p1", "p2", "scan"))
    sets = stored(sets)
    cut = _boundary(sets)
    sized = sets.select("node", F.col("n").cast("int").alias("n"), F.size("held").alias("held"), F.col("held").alias("shared"), "p1", "p2")
    lists = sized.where(F.col("n") * 100 > F.lit(cut * percent)).select(
        F.posexplode(F.slice("shared", F.lit(1), F.col("p1"))).alias("at", "key"), "node", "n", "held")
    heads = sized.where((F.col("n") <= cut) & (F.col("p2") > 1)).withColumn("head", F.slice("shared", F.lit(1), F.col("p2")))
    firsts = heads.select("node", "n", "held", "head", "p2", F.posexplode("head").alias("at", "one")).where("at + 1 < p2")
    subsets = firsts.select(F.explode(F.slice("head", F.col("at") + 2, F.col("p2"))).alias("two"), "one", "at", "node", "n", "held")
    subsets = subsets.select("at", F.xxhash64("one", "two").alias("key"), "node", "n", "held")
    entries = lists.unionByName(subsets).select("key", "node", "n", "held", (F.col("at") + 1).alias("at"))
    label = _linked_components(entries, sets, percent)

    result = described.join(nodes.select("node", "first"), "node", "left") if label is None else (
        described.join(_names(nodes, label), "node", "left"))
    lone_row = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).when(F.col("n_shingles") == 0, F.col("doc_id"))
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), lone_row).otherwise(F.col("first")).alias("component_id"))


def _names(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Smallest row id of each node's component."""
    marked = nodes.select("node", "first").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = marked.groupBy("comp").agg(F.min("first").alias("first"))
    return marked.select("node", "comp").join(low, "comp").select("node", "first")


def representatives(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row of each class, that with the smallest doc_id, and every row that links with nothing; all columns."""
    others = jaccard_classes(docs, percent, width).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
