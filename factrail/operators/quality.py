"""Completeness, drift, consistency and gate checks over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factrail.functions import observation as O
from factrail.functions.stats import ratio
from factrail.operators.pairing import ITEM, _count


def expected_grid(items: DataFrame, slots: Sequence[tuple[str, str]]) -> DataFrame:
    """Every item with every (condition, view) it should have: an explode of fixed values."""
    lit = ", ".join(f"named_struct('condition', '{c}', 'view', '{v}')" for c, v in slots)
    return items.select(*ITEM, F.expr(f"explode(array({lit})) AS s")).select(*ITEM, "s.condition", "s.view")


def missing(grid: DataFrame, observed: DataFrame) -> DataFrame:
    key = [*ITEM, "condition", "view"]
    return grid.join(observed.select(*key), key, "left_anti")


def completeness(records: DataFrame, items: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """(model, condition): expected, present, missing, errors, empty texts, long audio."""
    expected = items.groupBy("model").agg(F.count(F.lit(1)).alias("n_expected")).withColumn(
        "condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    seen = records.groupBy("model", "condition").agg(
        F.count(F.lit(1)).alias("n_present"), _count(F.coalesce(F.col("error") != "", F.lit(False))).alias("n_errors"),
        _count(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"),
        _count(O.is_long(F.col("duration"))).alias("n_long_audio"))
    out = expected.join(seen, ["model", "condition"], "left").fillna(0, ["n_present", "n_errors", "n_empty", "n_long_audio"])
    return out.withColumn("n_missing", F.col("n_expected") - F.col("n_present")).withColumn(
        "ready", (F.col("n_missing") == 0) & (F.col("n_errors") == 0))


def config_histogram(records: DataFrame) -> DataFrame:
    return records.where(F.col("config_hash").isNotNull()).groupBy("model", "config_hash").agg(F.count(F.lit(1)).alias("n"))


def config_drift(configs: DataFrame, keys: Sequence[str], decode_keys: Sequence[str]) -> DataFrame:
    """Runs whose records do not share one set of decoding settings."""
    distinct = F.count_distinct(F.struct(*decode_keys))
    return configs.groupBy(*keys).agg(distinct.alias("n_settings")).withColumn("compatible", F.col("n_settings") <= 1)


def complete_items(grid: DataFrame, records: DataFrame) -> DataFrame:
    """(model, n_items, n_complete): items whose every expected record is there without an error."""
    key = [*ITEM, "condition", "view"]
    ok = grid.join(records.withColumn("_ok", ~F.coalesce(F.col("error") != "", F.lit(False))), key, "left")
    per = ok.groupBy(*ITEM).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("complete"))
    return per.groupBy("model").agg(F.count(F.lit(1)).alias("n_items"), _count(F.col("complete")).alias("n_complete"))


def channel_states(channels: DataFrame, expected_version: Column, chunk_seconds: float | None) -> DataFrame:
    """Adds complete, current, reusable and the completed text to a long channel table."""
    done = O.complete(F.col("error"), F.col("sec"), F.col("text"))
    out = channels.withColumn("complete", done)
    out = out.withColumn("current", O.current(F.col("complete"), F.col("version"), expected_version))
    return out.withColumn("reusable", O.reusable(F.col("complete"), F.col("current"), F.col("duration"), chunk_seconds)).withColumn(
        "done_text", O.completed_text(F.col("complete"), F.col("text")))


def progress_ledger(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Done and pending recordings per channel and for the primary pair, from reusable channel states."""
    wide = states.groupBy(*keys, "item_id").agg(*[
        F.bool_or(F.when(F.col("channel") == v, F.col("reusable"))).alias(v) for v in ("asr1", "asr2", "asr3")])
    ok = {v: F.coalesce(F.col(v), F.lit(False)) for v in ("asr1", "asr2", "asr3")}
    n = F.count(F.lit(1))
    done = {**ok, "dual": ok["asr1"] & ok["asr2"]}
    aggs = [n.alias("n_recordings")]
    for name, c in done.items():
        aggs += [_count(c).alias(f"{name}_done"), _count(~c).alias(f"{name}_pending")]
    return wide.groupBy(*keys).agg(*aggs)


def work_list(grid: DataFrame, states: DataFrame, *, force: bool = False) -> DataFrame:
    """(keys of the grid): recordings whose channel still has to be read."""
    key = [*ITEM, "channel"]
    if force:
        return grid.select(*key)
    return grid.select(*key).join(states.where("reusable").select(*key), key, "left_anti")


def candidate_validation(grid: DataFrame, candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """(model): expected, present, complete three-view and text-identical candidates, and readiness.

    candidates (item, cand_idx, text, asr1..3); baseline (item, text).
    """
    key = [*ITEM, "cand_idx"]
    b = baseline.select(*ITEM, F.trim("text").alias("_base"))
    rows = grid.select(*key).join(candidates.withColumn("_there", F.lit(True)), key, "left").join(b, list(ITEM), "left")
    there = F.col("_there").isNotNull()
    three = there & F.col("asr1").isNotNull() & F.col("asr2").isNotNull() & F.col("asr3").isNotNull()
    same = there & F.coalesce(F.trim("text") == F.col("_base"), F.lit(False))
    out = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("expected"), _count(there).alias("n_present"), _count(three).alias("n_complete"),
        _count(same).alias("n_text_matches"))
    e = F.col("expected")
    return out.withColumn("ready", (F.col("n_present") == e) & (F.col("n_complete") == e) & (F.col("n_text_matches") == e))


def identical_text_items(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Items whose every candidate has the text of the original."""
    b = baseline.select(*ITEM, F.trim("text").alias("_base"))
    return candidates.join(b, list(ITEM)).groupBy(*ITEM).agg(
        F.bool_and(F.coalesce(F.trim("text") == F.col("_base"), F.lit(False))).alias("same"),
        _count(F.trim("text") == F.col("_base")).alias("n_matches")).where("same").select(*ITEM, "n_matches")


def coverage_by_number(candidates: DataFrame, number: str = "r_no") -> DataFrame:
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return candidates.groupBy(number).agg(
        F.count(F.lit(1)).alias("n_files"), *[_count(filled(v)).alias(v) for v in ("asr1", "asr2", "asr3")])


def crosscheck(recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tol: float = 5e-4) -> DataFrame:
    """Metric rows whose stored value is off by more than the tolerance, or not stored at all."""
    j = recomputed.select(*keys, F.col(value).alias("now")).join(stored.select(*keys, F.col(value).alias("saved"), F.lit(True).alias("_s")), list(keys), "left")
    finding = F.when(F.col("_s").isNull(), "not stored").when(F.abs(F.col("now") - F.col("saved")) > tol, "differs")
    return j.withColumn("finding", finding).where("finding IS NOT NULL").select(*keys, "now", "saved", "finding")


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str], invariant: Sequence[str]) -> DataFrame:
    """(keys, field, previous, current, allowed): every field that changed between two reports."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.field", f"x.{name}")

    j = long(previous, "previous").join(long(current, "current"), [*keys, "field"], "full")
    changed = j.where(~F.col("previous").eqNullSafe(F.col("current")))
    return changed.withColumn("allowed", ~F.col("field").isin(*invariant))


def alignment(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, finding): texts without a cached extraction, or with one of another text."""
    j = texts.select("key", "text").join(cached.select("key", F.col("text").alias("_cached"), F.lit(True).alias("_c")), "key", "left")
    finding = F.when(F.col("_c").isNull(), "missing").when(~F.col("text").eqNullSafe(F.col("_cached")), "mismatch")
    return j.withColumn("finding", finding).where("finding IS NOT NULL").select("key", "finding")


def known_forms(values: DataFrame, column: str) -> DataFrame:
    """Artifact values as they may be written: as is, absolute, and as percentages."""
    v = F.col(column)
    return values.select(F.explode(F.array(v, F.abs(v), F.abs(v) * 100)).alias("known")).distinct()


def explained_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``explained``: does a known value round to the written one, to half a unit in its last place?

    claims (value STRING with decimals). The tolerance differs by the number of decimals, so each
    claim meets the known values in the buckets of its own resolution: equal keys, no range scan.
    Known values are first reduced to one lowest and one highest value per (decimals, bucket): a bucket
    is as wide as the tolerance, so those two decide. A crowded bucket therefore joins two rows.
    """
    v = F.col("value").cast("double")
    dec = F.length(F.substring_index("value", ".", -1))
    tol = F.lit(0.5) * F.pow(F.lit(10.0), -dec) + F.lit(1e-9)
    c = claims.withColumn("v", v).withColumn("dec", dec).withColumn("tol", tol)
    places = c.select("dec", "tol").distinct().agg(F.array_sort(F.collect_set(F.struct("dec", "tol"))).alias("p"))
    k = known.select("known", F.explode(places.scalar()).alias("p")).select("known", "p.dec", "p.tol")
    k = k.groupBy("dec", F.floor(F.col("known") / F.col("tol")).alias("bucket")).agg(F.min("known").alias("lo"), F.max("known").alias("hi"))
    near = c.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("v") / F.col("tol")) + d for d in (-1, 0, 1)])))
    near = near.join(k, ["dec", "bucket"], "left")
    hit = (F.abs(F.col("lo") - F.col("v")) < F.col("tol")) | (F.abs(F.col("hi") - F.col("v")) < F.col("tol"))
    keys = claims.columns
    return near.groupBy(*keys).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("explained"))


def number_mentions(lines: DataFrame, text: str = "value", line: str = "line") -> DataFrame:
    """(value, line) of every decimal number that stands free in a line of text."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<![\w.])([0-9]+\.[0-9]+)(?![\w])"), F.lit(1))
    return lines.select(line, F.explode(found).alias("value")).distinct()


def unlisted(mentions: DataFrame, allowed: DataFrame, value: str = "value") -> DataFrame:
    """Distinct mentioned values that the whitelist does not hold; a NULL in either is no value."""
    listed = allowed.select(value).where(F.col(value).isNotNull()).distinct()
    return mentions.select(value).where(F.col(value).isNotNull()).distinct().join(listed, value, "left_anti")


def emission(records: DataFrame, minimum: float = 0.5) -> DataFrame:
    """(model): speech rows, those longer than the minimum, and whether all are."""
    r = records.where("audio IS NOT NULL AND coalesce(error, '') = ''")
    out = r.groupBy("model").agg(F.count(F.lit(1)).alias("n_speech"), _count(F.coalesce(F.col("duration") > minimum, F.lit(False))).alias("n_emitted"))
    return out.withColumn("pass", (F.col("n_speech") > 0) & (F.col("n_speech") == F.col("n_emitted"))).withColumn(
        "share", ratio(F.col("n_emitted"), F.col("n_speech")))


def inference_summary(records: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("error") != "", F.lit(False))
    per = records.groupBy(*ITEM).agg(
        _count(bad).alias("e"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("latency", F.lit(0.0))).alias("s"))
    return per.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_items"), _count(F.col("e") == 0).alias("n_items_clean"), F.sum("e").alias("n_condition_errors"),
        (F.sum("s") / F.sum("n")).alias("mean_latency"))


def first_errors(records: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The first error records in key order: a report, so it is cut by design."""
    return records.where("coalesce(error, '') <> ''").select(*keys, "error").orderBy(*keys).limit(limit)


def shard(df: DataFrame, key: str, num_shards: int, shard_index: int) -> DataFrame:
    """Rows whose position in key order is ``shard_index`` modulo ``num_shards``; keys are unique."""
    from factrail.operators.ranking import running_totals

    if num_shards < 1 or not 0 <= shard_index < num_shards:
        raise ValueError("shard_index must lie in [0, num_shards)")
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, [], key, "_one").where(F.col("before") % num_shards == shard_index).drop("_one", "before")


def position_slice(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows at positions [offset, offset + limit) in key order; keys are unique."""
    from factrail.operators.ranking import running_totals

    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, [], key, "_one").where(
        (F.col("before") >= offset) & (F.col("before") < offset + limit)).drop("_one", "before")
