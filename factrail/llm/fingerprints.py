"""Order MinHash fingerprints of texts: DataFrame functions only.

The k-mers of a text are its runs of K words, numbered by occurrence, so a repeated k-mer counts as often as it stands
there. Hashes of numbered k-mers fall into COMPONENTS x 2 bins; the least hash of each bin is a random selected k-mer.
A component takes the two k-mers of its two bins in their text order and hashes that tuple: it agrees between two texts
only if both keep the same k-mers in the same order, which follows edit distance and not only the overlap of sets. One
hash per k-mer serves all components (one-permutation hashing), instead of one pass per component. A component of which a
bin stays empty takes the two least of the text's selected k-mers by a hash of its own, so every component is a full tuple
when the text has two k-mers.

A text of fewer than FEW words, or of more than LONG characters a word (one word, or a script without spaces), takes runs
of K characters in place of words. Texts on different sides of these bounds share no k-mers.

The likeness of two fingerprints is the share of equal components among those that at least one of them fills; two without
any are alike (1.0).

Cases: null text counts as empty; a text with fewer than K characters has its whole sequence as the only k-mer; equal texts have
equal fingerprints; rows that repeat an id are ordered by text; a null id comes last in descending order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factrail.llm.common import materialise, parallelism

K = 3
COMPONENTS = 32
FEW = 16
LONG = 24
#: Ranges of ids per task; ranges bound the rows whose neighbours are looked up together.
RANGES_PER_TASK = 4
SPACE = "[\\x20\\x09-\\x0D]+"


def signatures(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, components (array<bigint>). Rows must be unique by keys, and stay where
    they are if they are already dealt out by one of them."""
    words = F.split(text, SPACE)
    by_character = (F.length(text) > 0) & ((F.size("w_") < FEW) | (F.length(text) > LONG * F.size("w_")))
    words = texts.select(*keys, text, words.alias("w_")).select(*keys, F.when(by_character, F.split(text, "")).otherwise(F.col("w_")).alias("w_"))
    zipped = F.arrays_zip(*[F.slice("w_", i + 1, F.size("w_")).alias(f"w{i}") for i in range(K)])
    kmers = words.select(*keys, F.posexplode(zipped).alias("pos_", "z_"))
    kmers = kmers.where(F.col(f"z_.w{K - 1}").isNotNull() | (F.col("pos_") == 0)).select(*keys, "pos_", F.xxhash64(*[F.col(f"z_.w{i}") for i in range(K)]).alias("kmer_"))
    keyed = kmers.withColumn("own_", F.xxhash64(*keys, "kmer_"))
    # the hash of row and k-mer leads the sort, so the order is settled by its prefix
    number = F.row_number().over(Window.partitionBy("own_", *keys).orderBy("pos_"))
    hashed = keyed.withColumn("h_", F.xxhash64("kmer_", number)).select(*keys, "pos_", "h_", F.pmod(F.col("h_"), F.lit(2 * COMPONENTS)).alias("bin_"))
    first, second = F.when(F.col("bin_") % 2 == 0, F.col("h_")), F.when(F.col("bin_") % 2 == 1, F.col("h_"))
    pairs = hashed.groupBy(*keys, F.floor(F.col("bin_") / 2).cast("int").alias("c_")).agg(
        F.min(first).alias("a_"), F.min_by("pos_", first).alias("pa_"), F.min(second).alias("b_"), F.min_by("pos_", second).alias("pb_"))
    found = pairs.groupBy(*keys).agg(F.collect_list(F.struct("c_", "a_", "pa_", "b_", "pb_")).alias("p_"))
    return found.select(*keys, _components(F.col("p_")).alias("components"))


def _tuple(a, pa, b, pb):
    """Hash of one or two k-mers in text order."""
    return F.when(b.isNull() | (pa < pb), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))


def _components(pairs):
    """The value of every component from the least k-mers of its bins; where a bin is empty, from the two that are least by
    the component's own hash among the k-mers of all bins."""
    full = F.map_from_entries(F.transform(
        F.filter(pairs, lambda p: p["a_"].isNotNull() & p["b_"].isNotNull()),
        lambda p: F.struct(p["c_"], _tuple(p["a_"], p["pa_"], p["b_"], p["pb_"]))))
    kept = F.filter(F.flatten(F.transform(pairs, lambda p: F.array(
        F.struct(p["a_"].alias("h"), p["pa_"].alias("at")), F.struct(p["b_"].alias("h"), p["pb_"].alias("at"))))), lambda x: x["h"].isNotNull())

    def refilled(kept, c):
        least = F.slice(F.array_sort(F.transform(kept, lambda x: F.struct(F.xxhash64(c, x["h"]).alias("o"), x["h"].alias("h"), x["at"].alias("at")))), 1, 2)
        pick = F.transform(F.array(least), lambda two: _tuple(F.get(two, F.lit(0))["h"], F.get(two, F.lit(0))["at"], F.get(two, F.lit(1))["h"], F.get(two, F.lit(1))["at"]))
        return F.get(pick, F.lit(0))

    # bound to a variable, both are made once per text and not once per component
    return F.flatten(F.transform(F.array(F.struct(full.alias("full"), kept.alias("kept"))), lambda s: F.transform(
        F.array(*[F.lit(i) for i in range(COMPONENTS)]), lambda c: F.coalesce(F.element_at(s["full"], c), refilled(s["kept"], c)))))


def likeness(a, b):
    either = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def written(components):
    """A fingerprint as text: eight hexadecimal digits per component, dots where it has none."""
    return F.array_join(F.transform(components, lambda v: F.coalesce(F.lower(F.right(F.lpad(F.hex(v), 16, "0"), F.lit(8))), F.lit("........"))), "")


def _chained(docs: DataFrame) -> DataFrame:
    """bucket_, n_ (place in the bucket), ghost_, doc_id, text of all rows in descending doc_id order. Each bucket, a range
    of ids, ends with a ghost: the row that follows it."""
    spark = docs.sparkSession
    buckets = RANGES_PER_TASK * parallelism(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    cuts = F.lit(sorted(set(cuts))) if cuts else F.expr("cast(array() as array<bigint>)")
    later = F.when(F.col("doc_id").isNull(), F.size(cuts) + 1).otherwise(F.size(F.filter(cuts, lambda c: c >= F.col("doc_id"))))
    rows = rows.withColumn("bucket_", later)
    heads = materialise(rows.groupBy("bucket_").agg(F.max("doc_id").alias("doc_id")))
    # one row per bucket: their number is the number of ranges, not of documents
    around = Window.orderBy("bucket_")
    turn = heads.select("bucket_", F.coalesce(F.lag("bucket_").over(around), F.max("bucket_").over(Window.partitionBy())).alias("before_"))
    first = rows.alias("r").join(F.broadcast(heads.alias("h")), (F.col("r.bucket_") == F.col("h.bucket_")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id"))).groupBy(
        "r.bucket_").agg(F.first("r.doc_id").alias("doc_id"), F.min("r.text").alias("text"))
    ghosts = first.join(turn, "bucket_").select("doc_id", "text", F.col("before_").alias("bucket_"))
    all_rows = rows.withColumn("ghost_", F.lit(False)).unionByName(ghosts.withColumn("ghost_", F.lit(True)))
    dealt = all_rows.repartition(buckets, "bucket_")
    return dealt.withColumn("n_", F.row_number().over(Window.partitionBy("bucket_").orderBy("ghost_", F.col("doc_id").desc_nulls_last(), "text")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    order = Window.partitionBy("bucket_").orderBy("n_")
    rows = _chained(docs).withColumn("next_", F.lead("text").over(order))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.when(~F.col("ghost_"), F.concat(F.left("text", n - third), F.left("next_", third)))
    rows = rows.withColumn("edited_", edited)
    # only two numbers go with every k-mer; what a row returns is joined to its fingerprint
    texts = rows.select("bucket_", F.explode(F.array(F.struct((2 * F.col("n_")).cast("bigint").alias("key_"), F.col("text").alias("text")),
                                                     F.struct((2 * F.col("n_") + 1).cast("bigint").alias("key_"), F.col("edited_").alias("text")))).alias("s_")).select("bucket_", "s_.*")
    found = signatures(texts.where("text is not null"), ["bucket_", "key_"], "text").withColumn("n_", F.floor(F.col("key_") / 2).cast("int"))
    own = F.col("key_") % 2 == 0
    both = found.groupBy("bucket_", "n_").agg(
        F.first(F.when(own, F.col("components")), True).alias("f"), F.first(F.when(~own, F.col("components")), True).alias("e"))
    both = both.withColumn("g", F.lead("f").over(order))
    facts = rows.where("not ghost_").select("bucket_", "n_", "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited_", 256).alias("edited_sha256"))
    return facts.join(both, ["bucket_", "n_"]).select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("f")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"))
