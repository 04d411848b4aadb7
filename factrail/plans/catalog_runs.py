"""Registered queries: run records, caches, merging, audit packets, quality checks, marts, the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factrail.dims import FACT_TYPES, MODES, VIEWS, Pair, decomposition_pairs, planned, spoken
from factrail.functions import similarity as E
from factrail.functions import text as T
from factrail.functions.stats import r6, ratio
from factrail.operators import audit as U
from factrail.operators import merging as MG
from factrail.operators import pairing as P
from factrail.operators import quality as D
from factrail.operators import selection as S
from factrail.operators import tasks as TK
from factrail.operators.pairing import ITEM, _count
from factrail.plans import fixtures as X
from factrail.plans import marts as R
from factrail.plans import metrics as M
from factrail.plans import oracle_text as O
from factrail.plans.catalog_paths import (
    SQL_A03, TAX, _decomposition_sql, j08, observed, observed_flags, presence, sql_pooled, sql_seen,
)
from factrail.plans.catalog_selection import B1, FXC, SUMMARY, counts, pools, rounded, sql_counts, sql_folds, sql_paired, sql_wide, wide
from factrail.plans.oracle_fixtures import FX, FX_VIEWS, with_fx
from factrail.plans.registry import query
from factrail.session import checkpoint_dir, materialise, parallelism
from factrail.sources import readers
from factrail.sources.buckets import read_table, upsert_table

# ---- channel states from the event table ---------------------------------------------------

CHANNELS = {"ch": """SELECT event_id, event_id // 3 AS item_id, 'm' || CAST((event_id // 3) % 4 AS VARCHAR) AS model,
 CASE event_type WHEN 'signup' THEN 'asr1' WHEN 'view' THEN 'asr2' WHEN 'click' THEN 'asr3' WHEN 'purchase' THEN 'asr1' ELSE 'asr2' END AS channel,
 CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_id % 11 = 0 THEN '' END AS error, CASE WHEN event_id % 3 <> 0 THEN value END AS sec,
 CASE WHEN event_id % 4 <> 0 THEN props END AS text, 'v' || CAST(event_id % 3 AS VARCHAR) AS version, CASE WHEN event_id % 13 <> 0 THEN value END AS duration FROM events""",
 "cs": "SELECT *, (error IS NULL OR error = '') AND (sec IS NOT NULL OR text IS NOT NULL) AS complete FROM ch",
 "cu": "SELECT *, complete AND version IS NOT DISTINCT FROM 'v1' AS current FROM cs",
 "st": "SELECT *, CASE WHEN duration IS NULL OR duration > 30 THEN current ELSE complete END AS reusable, CASE WHEN complete THEN coalesce(text, '') END AS done_text FROM cu"}


def channels(spark: SparkSession, sf: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    item = F.expr("event_id div 3")
    channel = (F.when(t == "signup", "asr1").when(t == "view", "asr2").when(t == "click", "asr3").when(t == "purchase", "asr1").otherwise("asr2"))
    return X.table(spark, sf, "events").select(
        "event_id", item.alias("item_id"), F.concat(F.lit("m"), (item % 4).cast("string")).alias("model"), channel.alias("channel"),
        F.when(t == "error", "timeout").when(e % 11 == 0, "").alias("error"), F.when(e % 3 != 0, F.col("value")).alias("sec"),
        F.when(e % 4 != 0, F.col("props")).alias("text"), F.concat(F.lit("v"), (e % 3).cast("string")).alias("version"),
        F.when(e % 13 != 0, F.col("value")).alias("duration"))


def states(spark, sf):
    return D.channel_states(channels(spark, sf), F.lit("v1"), 30.0)


@query("p03_reusable_channels", with_fx(extra=CHANNELS) + """SELECT event_id, complete, current, reusable, done_text,
 CASE WHEN duration <= 15 THEN 'le15' WHEN duration <= 30 THEN '15to30' WHEN duration > 30 THEN 'gt30' END AS duration_group, coalesce(duration > 30, false) AS long_audio FROM st""")
def p03(spark, sf):
    from factrail.functions import observation as OB

    return states(spark, sf).select("event_id", "complete", "current", "reusable", "done_text",
                                    OB.duration_group(F.col("duration")).alias("duration_group"), OB.is_long(F.col("duration")).alias("long_audio"))


JOBS = {**CHANNELS, "wide": "SELECT model, item_id, max(done_text) FILTER (channel='asr1') AS asr1, max(done_text) FILTER (channel='asr2') AS asr2, max(done_text) FILTER (channel='asr3') AS asr3 FROM st GROUP BY model, item_id",
        "rec": "SELECT *, item_id % 5 <> 0 AS wants_audio, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'text ' || item_id END AS text FROM wide",
        "jobs": """SELECT model, item_id, view, t AS text FROM (
 SELECT model, item_id, 'text' AS view, CASE WHEN NOT wants_audio THEN text END AS t FROM rec UNION ALL SELECT model, item_id, 'internal', CASE WHEN wants_audio AND text <> '' THEN text END FROM rec
 UNION ALL SELECT model, item_id, 'asr1', CASE WHEN wants_audio THEN coalesce(asr1, asr2) END FROM rec UNION ALL SELECT model, item_id, 'asr2', CASE WHEN wants_audio THEN asr2 END FROM rec
 UNION ALL SELECT model, item_id, 'asr3', CASE WHEN wants_audio THEN asr3 END FROM rec) WHERE t IS NOT NULL"""}


@query("p06_extraction_jobs", with_fx(extra=JOBS) + "SELECT model, item_id, view, text, substr(sha256(text), 1, 16) AS text_hash FROM jobs")
def p06(spark, sf):
    wide = states(spark, sf).groupBy("model", "item_id").agg(*[F.max(F.when(F.col("channel") == v, F.col("done_text"))).alias(v) for v in VIEWS])
    text = F.when(F.col("item_id") % 4 == 0, "").otherwise(F.concat(F.lit("text "), F.col("item_id").cast("string")))
    rec = wide.select("*", F.lit("SPEAK").alias("condition"), (F.col("item_id") % 5 != 0).alias("wants_audio"), text.alias("text"))
    return readers.extraction_jobs(rec).drop("condition")


@query("p17_work_list", with_fx(extra={**CHANNELS, "g": "SELECT DISTINCT model, item_id, c.channel FROM ch CROSS JOIN (VALUES ('asr1'),('asr2'),('asr3')) c(channel)"})
       + "SELECT g.model, g.item_id, g.channel FROM g WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.model=g.model AND st.item_id=g.item_id AND st.channel=g.channel AND st.reusable)")
def p17(spark, sf):
    grid = P.dimension(channels(spark, sf).select(*ITEM).distinct(), "channel", VIEWS)
    return D.work_list(grid, states(spark, sf))


@query("d05_progress_ledger", with_fx(extra={**CHANNELS, "w": """SELECT model, item_id, coalesce(bool_or(reusable) FILTER (channel='asr1'), false) AS a, coalesce(bool_or(reusable) FILTER (channel='asr2'), false) AS b,
 coalesce(bool_or(reusable) FILTER (channel='asr3'), false) AS c FROM st GROUP BY model, item_id"""})
 + """SELECT model, count(*) AS n_recordings, count(*) FILTER (a) AS asr1_done, count(*) FILTER (NOT a) AS asr1_pending, count(*) FILTER (b) AS asr2_done, count(*) FILTER (NOT b) AS asr2_pending,
 count(*) FILTER (c) AS asr3_done, count(*) FILTER (NOT c) AS asr3_pending, count(*) FILTER (a AND b) AS dual_done, count(*) FILTER (NOT (a AND b)) AS dual_pending FROM w GROUP BY model""")
def d05(spark, sf):
    return D.progress_ledger(states(spark, sf), ["model"])


RECORDS = {"rec": """SELECT 'm' || CAST(user_id % 4 AS VARCHAR) AS model, user_id AS item_id, event_type AS condition, event_id, CASE WHEN event_id % 19 = 0 THEN 'boom ' || event_id END AS error,
 CASE WHEN event_id % 6 = 0 THEN '  ' ELSE props END AS text, value AS duration, CASE WHEN event_id % 8 <> 0 THEN 'x.wav' END AS audio, CAST(event_id % 97 AS DOUBLE) AS latency,
 'cfg' || CAST((user_id + event_id % 2) % 3 AS VARCHAR) AS config_hash, user_id % 2 AS beams, event_id % 5 AS note FROM events"""}


def records(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    return X.table(spark, sf, "events").select(
        F.concat(F.lit("m"), (u % 4).cast("string")).alias("model"), u.alias("item_id"), F.col("event_type").alias("condition"), "event_id",
        F.when(e % 19 == 0, F.concat(F.lit("boom "), e.cast("string"))).alias("error"), F.when(e % 6 == 0, "  ").otherwise(F.col("props")).alias("text"),
        F.col("value").alias("duration"), F.when(e % 8 != 0, "x.wav").alias("audio"), (e % 97).cast("double").alias("latency"),
        F.concat(F.lit("cfg"), ((u + e % 2) % 3).cast("string")).alias("config_hash"), (u % 2).alias("beams"), (e % 5).alias("note"))


@query("d01_run_completeness", with_fx(extra={**RECORDS,
    "e": "SELECT model, condition, n_expected FROM (SELECT model, count(*) AS n_expected FROM (SELECT DISTINCT model, item_id FROM rec) GROUP BY model) CROSS JOIN (VALUES ('signup'),('view'),('click'),('replay')) c(condition)",
    "s": "SELECT model, condition, count(*) AS n_present, count(*) FILTER (error <> '') AS n_errors, count(*) FILTER (trim(text) = '') AS n_empty, count(*) FILTER (duration > 30) AS n_long_audio FROM rec GROUP BY ALL"})
 + """SELECT e.model, e.condition, n_expected, coalesce(n_present,0) AS n_present, coalesce(n_errors,0) AS n_errors, coalesce(n_empty,0) AS n_empty, coalesce(n_long_audio,0) AS n_long_audio,
 n_expected - coalesce(n_present,0) AS n_missing, n_expected = coalesce(n_present,0) AND coalesce(n_errors,0) = 0 AS ready FROM e LEFT JOIN s ON s.model=e.model AND s.condition=e.condition""")
def d01(spark, sf):
    r = records(spark, sf)
    return D.completeness(r, r.select(*ITEM).distinct(), ["signup", "view", "click", "replay"])


@query("d01_config_histogram", with_fx(extra=RECORDS) + "SELECT model, config_hash, count(*) AS n FROM rec GROUP BY ALL")
def d01c(spark, sf):
    return D.config_histogram(records(spark, sf))


@query("d03_config_drift", with_fx(extra=RECORDS) + "SELECT model, item_id, count(DISTINCT (beams, note % 2)) AS n_settings, count(DISTINCT (beams, note % 2)) <= 1 AS compatible FROM rec GROUP BY model, item_id")
def d03(spark, sf):
    return D.config_drift(records(spark, sf).withColumn("mode", F.col("note") % 2), list(ITEM), ["beams", "mode"])


@query("d11_emission", with_fx(extra=RECORDS) + """SELECT model, count(*) AS n_speech, count(*) FILTER (duration > 0.5) AS n_emitted, count(*) = count(*) FILTER (duration > 0.5) AS pass,
 CAST(count(*) FILTER (duration > 0.5) AS DOUBLE)/count(*) AS share FROM rec WHERE audio IS NOT NULL AND coalesce(error,'') = '' GROUP BY model""")
def d11(spark, sf):
    return D.emission(records(spark, sf))


@query("a18_inference_summary", with_fx(extra={**RECORDS, "p": "SELECT model, item_id, count(*) FILTER (error <> '') AS e, count(*) AS n, sum(latency) AS s FROM rec GROUP BY ALL"})
       + "SELECT model, count(*) AS n_items, count(*) FILTER (e = 0) AS n_items_clean, CAST(sum(e) AS BIGINT) AS n_condition_errors, round(sum(s)/sum(n), 6) AS mean_latency FROM p GROUP BY model")
def a18(spark, sf):
    return rounded(D.inference_summary(records(spark, sf)), ["mean_latency"])


@query("w18_first_errors", with_fx(extra=RECORDS) + "SELECT model, item_id, condition, event_id, error FROM rec WHERE error <> '' ORDER BY model, item_id, condition, event_id LIMIT 100")
def w18(spark, sf):
    return D.first_errors(records(spark, sf), ["model", "item_id", "condition", "event_id"], 100)


SLOT_ROWS = [(c, v) for c, v, _, _ in FX_VIEWS]


@query("j14_grid_missing", with_fx("fx_items", "fx_views", "fx_observed") + """SELECT model, condition, view, count(*) AS n_missing, CAST(sum(item_id) AS BIGINT) AS id_sum FROM (
 SELECT i.model, i.item_id, v.condition, v.view FROM fx_items i CROSS JOIN fx_views v EXCEPT SELECT model, item_id, condition, view FROM fx_observed) GROUP BY ALL""")
def j14(spark, sf):
    grid = D.expected_grid(X.items(spark, sf), SLOT_ROWS)
    return D.missing(grid, X.observed(spark, sf)).groupBy("model", "condition", "view").agg(
        F.count(F.lit(1)).alias("n_missing"), F.sum("item_id").alias("id_sum"))


@query("d04_complete_items", with_fx("fx_items", "fx_views", "fx_observed", extra={
    "n": "SELECT model, item_id, count(*) FILTER (NOT (item_id % 23 = 0 AND condition = 'EF')) AS k FROM fx_observed GROUP BY ALL"})
 + f"SELECT i.model, count(*) AS n_items, count(*) FILTER (k = {len(SLOT_ROWS)}) AS n_complete FROM fx_items i LEFT JOIN n ON n.model=i.model AND n.item_id=i.item_id GROUP BY i.model")
def d04(spark, sf):
    grid = D.expected_grid(X.items(spark, sf), SLOT_ROWS)
    bad = F.when((F.col("item_id") % 23 == 0) & (F.col("condition") == "EF"), "boom")
    return D.complete_items(grid, X.observed(spark, sf).withColumn("error", bad))


# ---- caches and merging --------------------------------------------------------------------

CACHE = {"raw": """SELECT CASE WHEN k % 3 = 0 THEN item_id || '|SPEAK' END AS key, CASE WHEN k % 3 <> 0 THEN item_id END AS item_id, CASE WHEN k % 3 <> 0 AND k % 7 <> 0 THEN 'SPEAK' END AS condition,
 CASE WHEN k % 5 = 0 THEN text || ' (edited)' ELSE text END AS text, CASE WHEN k % 4 = 0 THEN 'p0' ELSE 'p1' END AS prompt_sha256, rep, CASE WHEN k % 10 = 9 THEN '{broken' END AS bad, item_id AS src, k
 FROM (SELECT item_id, text, rep, length(text) + length(item_id) + rep AS k FROM fx_text CROSS JOIN (VALUES (0),(1)) t(rep))""",
 "cache": """SELECT coalesce(nullif(key, ''), CASE WHEN item_id <> '' AND condition <> '' THEN item_id || '|' || condition END) AS key, text, prompt_sha256, rep, src FROM raw WHERE bad IS NULL"""}


def cache_rows(spark, sf):
    s = X.sentences(spark, sf).select("*", F.expr("explode(array(0, 1)) AS rep"))
    k = F.length("text") + F.length("item_id") + F.col("rep")
    return s.select(
        F.when(k % 3 == 0, F.concat("item_id", F.lit("|SPEAK"))).alias("key"), F.when(k % 3 != 0, F.col("item_id")).alias("item_id"),
        F.when((k % 3 != 0) & (k % 7 != 0), "SPEAK").alias("condition"),
        F.when(k % 5 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")).alias("text"),
        F.when(k % 4 == 0, "p0").otherwise("p1").alias("prompt_sha256"), F.col("rep").alias("ordinal"),
        F.when(k % 10 == 9, "{broken").alias("_corrupt_record"))


@query("s04_cache_scan", with_fx("fx_text", extra=CACHE) + """SELECT key, text, ordinal FROM (SELECT key, text, rep AS ordinal, row_number() OVER (PARTITION BY key ORDER BY rep DESC) AS rn
 FROM cache WHERE key IS NOT NULL AND prompt_sha256 = 'p1') WHERE rn = 1""")
def s04(spark, sf):
    rows = cache_rows(spark, sf).withColumn("line", F.col("ordinal"))
    return readers.last_extractions(rows, prompt_sha256="p1").select("key", "text", F.col("line").alias("ordinal"))


@query("m04_incremental_plan", with_fx("fx_text", extra={**CACHE,
    "pri": "SELECT item_id || '|SPEAK' AS key, CASE WHEN length(item_id) % 2 = 0 THEN text ELSE lower(text) END AS text FROM fx_text WHERE length(text) % 3 = 0",
    "ca": "SELECT key, substr(sha256(text), 1, 16) AS h FROM (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY rep DESC) AS rn FROM cache WHERE key IS NOT NULL AND prompt_sha256='p1') WHERE rn=1"})
 + """SELECT t.item_id || '|SPEAK' AS key, CASE WHEN p.text = t.text THEN 'prior' WHEN ca.h = substr(sha256(t.text),1,16) THEN 'cache' ELSE 'fresh' END AS fact_origin, substr(sha256(t.text),1,16) AS text_hash
 FROM fx_text t LEFT JOIN pri p ON p.key = t.item_id || '|SPEAK' LEFT JOIN ca ON ca.key = t.item_id || '|SPEAK'""")
def m04(spark, sf):
    s = X.sentences(spark, sf)
    key = F.concat("item_id", F.lit("|SPEAK")).alias("key")
    prior = s.where(F.length("text") % 3 == 0).select(key, F.when(F.length("item_id") % 2 == 0, F.col("text")).otherwise(F.lower("text")).alias("text"))
    cached = readers.last_extractions(cache_rows(spark, sf), prompt_sha256="p1").select("key", T.text_hash("text").alias("text_hash"), "prompt_sha256")
    return MG.incremental_plan(s.select(key, "text"), prior, cached, "p1").select("key", "fact_origin", "text_hash")


@query("m05_invalidate_cache", with_fx("fx_text") + """SELECT item_id, CASE WHEN length(text) % 4 = 0 THEN 0 ELSE 1 END AS n_facts, CASE WHEN length(text) % 4 = 0 THEN 'invalidated: prompt changed' END AS llm_error FROM fx_text WHERE length(text) % 5 <> 0""")
def m05(spark, sf):
    n = F.length("text")
    fact = F.array(F.struct(F.lit("unit").alias("type"), F.lit("meter").alias("value"), F.lit("+").alias("polarity")))
    c = X.sentences(spark, sf).select("item_id", "text", F.when(n % 5 == 0, "0000").otherwise(T.text_hash("text")).alias("text_hash"),
                                      F.when(n % 4 == 0, "p0").otherwise("p1").alias("prompt_sha256"), fact.alias("facts_llm"), F.lit(None).cast("string").alias("llm_error"))
    return MG.invalidate_cache(c, "p1").select("item_id", F.size("facts_llm").alias("n_facts"), "llm_error")


M6 = {"old": "SELECT item_id, 'asr1' AS channel, asr1 AS text, CAST(NULL AS VARCHAR) AS error, 1.0::DOUBLE AS sec, 'w1' AS version FROM fx_heard UNION ALL SELECT item_id, 'asr3', asr3, NULL, 2.0, 'f1' FROM fx_heard",
      "new": "SELECT item_id, 'asr2' AS channel, asr2 AS text, CASE WHEN length(text) % 9 = 0 THEN 'fail' END AS error, 3.0::DOUBLE AS sec, 's1' AS version FROM fx_heard UNION ALL SELECT item_id, 'asr1', asr3, NULL, 4.0, '' FROM fx_heard WHERE length(text) % 4 = 0",
      "mg": """SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(o.channel, n.channel) AS channel, CASE WHEN n.item_id IS NOT NULL THEN n.text ELSE o.text END AS text,
 CASE WHEN n.item_id IS NOT NULL THEN n.error ELSE o.error END AS error, CASE WHEN n.item_id IS NOT NULL THEN n.sec ELSE o.sec END AS sec, coalesce(nullif(n.version, ''), o.version) AS version
 FROM old o FULL JOIN new n ON n.item_id=o.item_id AND n.channel=o.channel"""}


def m6(spark, sf):
    h = X.transcripts(spark, sf).select(F.lit("m").alias("model"), "item_id", F.lit("SPEAK").alias("condition"), "text", *VIEWS)
    key = ["model", "item_id", "condition"]
    null = F.lit(None).cast("string")
    row = lambda c, t, e, s, v: F.struct(F.lit(c).alias("channel"), t.alias("text"), e.alias("error"), F.lit(s).alias("sec"), F.lit(v).alias("version"))
    explode = lambda df, *rows: df.select(*key, F.explode(F.array(*rows)).alias("r")).select(*key, "r.*")
    old = explode(h, row("asr1", F.col("asr1"), null, 1.0, "w1"), row("asr3", F.col("asr3"), null, 2.0, "f1"))
    n = F.length("text")
    new = explode(h, row("asr2", F.col("asr2"), F.when(n % 9 == 0, "fail"), 3.0, "s1")).unionByName(
        explode(h.where(n % 4 == 0), row("asr1", F.col("asr3"), null, 4.0, "")))
    return MG.merge_readbacks(old, new), h


@query("m06_readback_upsert", with_fx("fx_heard", extra=M6) + "SELECT item_id, channel, text, error, sec, version FROM mg")
def m06(spark, sf):
    return m6(spark, sf)[0].select("item_id", "channel", "text", "error", "sec", "version")


@query("m06_readback_metrics", with_fx("fx_heard", extra={**M6,
    "w": "SELECT item_id, max(CASE WHEN coalesce(error,'')='' THEN text END) FILTER (channel='asr1') AS a1, max(CASE WHEN coalesce(error,'')='' THEN text END) FILTER (channel='asr2') AS a2 FROM mg GROUP BY item_id",
    "n": f"SELECT item_id, {O.normalise('a1')} AS a1, {O.normalise('a2')} AS a2, {O.normalise('lower(text)')} AS ref, {O.normalise('text')} AS self FROM w JOIN fx_heard USING (item_id)",
    "e": f"SELECT item_id, {O.wer('a1', 'a2')} AS agreement_wer, {O.wer('ref', 'a1')} AS readback_wer, {O.wer('self', 'a1')} AS readback_wer_vs_self FROM n"})
 + "SELECT *, coalesce(agreement_wer <= 0.2, false) AS asr_agree, coalesce(readback_wer_vs_self < 0.5, false) AS audio_intelligible FROM e")
def m06m(spark, sf):
    merged, h = m6(spark, sf)
    refs = h.select("model", "item_id", "condition", F.lower("text").alias("reference_text"), F.col("text").alias("self_text"))
    return MG.readback_metrics(merged, refs).drop("model", "condition")


TWO = {"ru": "SELECT DISTINCT model, item_id, type, value, polarity FROM fx_facts WHERE condition='SPEAK' AND view='internal'",
       "md": "SELECT DISTINCT model, item_id, CASE WHEN type='content' AND CAST(value AS BIGINT) % 3 = 0 THEN 'proper_noun' ELSE type END AS type, value, polarity FROM fx_facts WHERE condition='EF' AND view='internal'",
       "mm": """SELECT coalesce(r.model,m.model) AS model, coalesce(r.item_id,m.item_id) AS item_id, coalesce(r.value,m.value) AS value, coalesce(r.polarity,m.polarity) AS polarity, r.type AS rule_type, m.type AS model_type,
 CASE WHEN r.type IN ('number','unit','negation') THEN r.type ELSE coalesce(m.type, r.type) END AS type, r.type IS NULL OR m.type IS NULL AS conflict, coalesce(r.type <> m.type, false) AS type_conflict
 FROM ru r FULL JOIN md m ON m.model=r.model AND m.item_id=r.item_id AND m.value=r.value AND m.polarity=r.polarity"""}


def two_sources(spark, sf):
    f = X.facts(spark, sf)
    rules = f.where("condition = 'SPEAK' AND view = 'internal'").select(*ITEM, *P.FACT_KEY)
    kind = F.when((F.col("type") == "content") & (F.col("value").cast("bigint") % 3 == 0), "proper_noun").otherwise(F.col("type"))
    model = f.where("condition = 'EF' AND view = 'internal'").select(*ITEM, kind.alias("type"), "value", "polarity")
    return rules, model


@query("m01_merge_channels", with_fx("fx_facts", extra=TWO) + "SELECT * FROM mm")
def m01(spark, sf):
    return MG.merge_channels(*two_sources(spark, sf), list(ITEM))


@query("m07_kappa", with_fx("fx_facts", extra={**TWO,
    "v": """SELECT model, item_id, value, bool_or(src='r') AS a, bool_or(src='m') AS b, coalesce(bool_or(src='r' AND type IN ('number','unit','proper_noun')),false) AS sa,
 coalesce(bool_or(src='m' AND type IN ('number','unit','proper_noun')),false) AS sb FROM (SELECT 'r' AS src, * FROM ru UNION ALL SELECT 'm', * FROM md) GROUP BY ALL""",
    "t": "SELECT model, count(*) AS nv, count(*) FILTER (a<>b) AS vc, count(*) FILTER (sa OR sb) AS n, count(*) FILTER (sa) AS a1, count(*) FILTER (sb) AS b1, count(*) FILTER (sa AND sb) AS ab FROM v GROUP BY model",
    "tc": "SELECT model, count(*) FILTER (type_conflict) AS tc FROM mm GROUP BY model",
    "c": "SELECT model, count(*) FILTER (src='r') AS cr, count(*) FILTER (src='m') AS cm FROM (SELECT 'r' AS src, * FROM ru UNION ALL SELECT 'm', * FROM md) WHERE type='content' GROUP BY model",
    "k": "SELECT *, CAST(ab AS DOUBLE)/n AS po, CAST(a1 AS DOUBLE)/n AS pa, CAST(b1 AS DOUBLE)/n AS pb FROM t JOIN tc USING (model) JOIN c USING (model)"})
 + """SELECT model, n AS n_units, nv AS n_candidate_values, vc AS n_value_conflicts, tc AS n_type_conflicts, CAST(vc AS DOUBLE)/nv AS value_conflict_rate, CAST(tc AS DOUBLE)/nv AS type_conflict_rate,
 cr AS content_rules, cm AS content_model, round((po-(pa*pb+(1-pa)*(1-pb)))/(1-(pa*pb+(1-pa)*(1-pb))),6) AS kappa FROM k""")
def m07(spark, sf):
    return rounded(MG.kappa(*two_sources(spark, sf), list(ITEM), ["model"]), ["kappa"])


SNAP = {**TWO, "bo": """SELECT coalesce(r.model,m.model) AS model, coalesce(r.item_id,m.item_id) AS item_id, coalesce(r.type,m.type) AS type, r.value IS NOT NULL AND m.value IS NOT NULL AS both_
 FROM ru r FULL JOIN md m ON m.model=r.model AND m.item_id=r.item_id AND m.value=r.value AND m.polarity=r.polarity AND m.type=r.type"""}


@query("m08_snapshot_agreement", with_fx("fx_facts", "fx_items", extra={**SNAP,
    "k": "SELECT i.model, i.item_id, count(*) FILTER (both_) AS i, count(both_) AS u FROM fx_items i LEFT JOIN bo ON bo.model=i.model AND bo.item_id=i.item_id GROUP BY i.model, i.item_id"})
 + """SELECT model, count(*) AS n_texts, CAST(count(*) FILTER (i=u) AS DOUBLE)/count(*) AS strict_agreement, 1.0-CAST(count(*) FILTER (i=u) AS DOUBLE)/count(*) AS drift_rate, CAST(sum(i) AS DOUBLE)/CAST(sum(u) AS DOUBLE) AS fact_jaccard,
 CAST(sum(u) AS BIGINT) AS facts_union, CAST(sum(u)-sum(i) AS BIGINT) AS symmetric_difference FROM k GROUP BY model""")
def m08(spark, sf):
    return MG.compare_snapshots(*two_sources(spark, sf), X.items(spark, sf), list(ITEM), ["model"])[0]


@query("m08_type_agreement", with_fx("fx_facts", extra=SNAP) + "SELECT model, type, count(*) AS support, count(*) FILTER (both_) AS n_both, CAST(count(*) FILTER (both_) AS DOUBLE)/count(*) AS agreement FROM bo GROUP BY model, type")
def m08t(spark, sf):
    return MG.compare_snapshots(*two_sources(spark, sf), X.items(spark, sf), list(ITEM), ["model"])[1]


@query("s07_cache_upsert", with_fx("fx_text", extra={"o": "SELECT item_id AS key, text, 'old' AS origin FROM fx_text WHERE length(text) % 3 <> 0", "n": "SELECT item_id AS key, lower(text) AS text, 'new' AS origin FROM fx_text WHERE length(text) % 2 = 0"})
       + "SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n")
def s07(spark, sf):
    s = X.sentences(spark, sf)
    old = s.where(F.length("text") % 3 != 0).select(F.col("item_id").alias("key"), "text", F.lit("old").alias("origin"))
    new = s.where(F.length("text") % 2 == 0).select(F.col("item_id").alias("key"), F.lower("text").alias("text"), F.lit("new").alias("origin"))
    root = f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    put = lambda was, batch: batch if was is None else MG.upsert(was, batch, ["key"])
    upsert_table(old, root, 1, ["key"], put)
    upsert_table(new, root, 2, ["key"], put)
    return read_table(spark, root)


@query("s08_merge_shards", with_fx("fx_text") + "SELECT item_id, length(text) % 3 AS shard, CAST(length(text) AS BIGINT) AS n_chars FROM fx_text")
def s08(spark, sf):
    s = X.sentences(spark, sf).select("item_id", (F.length("text") % 3).cast("bigint").alias("shard"), F.length("text").cast("bigint").alias("n_chars"))
    parts = [s.where(F.col("shard") == k) for k in range(3)]
    return MG.unique_keys(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["item_id"])


@query("s10_stable_output", with_fx("fx_facts") + "SELECT model, item_id, condition, string_agg(DISTINCT type || ':' || value || polarity, ' ' ORDER BY type || ':' || value || polarity) AS facts FROM (SELECT * FROM fx_facts WHERE view IN ('text','internal')) GROUP BY ALL")
def s10(spark, sf):
    from factrail.sources.writers import item_scores

    rows = X.facts(spark, sf).where("view IN ('text', 'internal')").drop("view")
    out = item_scores(rows)
    label = F.transform("facts", lambda f: F.concat(f["type"], F.lit(":"), f["value"], f["polarity"]))
    return out.select("model", "item_id", F.explode("scores").alias("condition", "facts")).select(
        "model", "item_id", "condition", F.array_join(F.array_sort(label), " ").alias("facts"))


@query("s11_shards", with_fx("fx_items") + "SELECT model, item_id FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i FROM fx_items) WHERE i % 7 = 3")
def s11(spark, sf):
    return D.shard(X.items(spark, sf), "item_id", 7, 3).select("model", "item_id")


@query("s11_slice", with_fx("fx_text") + "SELECT item_id FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i FROM fx_text) WHERE i >= 500 AND i < 1500")
def s11s(spark, sf):
    return D.position_slice(X.sentences(spark, sf), "item_id", 500, 1000).select("item_id")


CORPUS = {"b": "SELECT model, item_id, plan_text AS text, CASE WHEN item_id % 11 <> 0 THEN asr1 ELSE '' END AS asr1, asr2, CASE WHEN item_id % 6 <> 0 THEN asr3 END AS asr3 FROM fx_order_text WHERE cand_idx = 0",
    "r": "SELECT model, item_id, cand_idx AS r_no, asr1, CASE WHEN (item_id + cand_idx) % 5 <> 0 THEN asr2 END AS asr2, CASE WHEN (item_id + cand_idx) % 17 <> 0 THEN asr3 END AS asr3 FROM fx_order_text WHERE cand_idx > 0",
    "z": "SELECT model, item_id, text AS plan_text, -1 AS r_no, asr1, asr2, asr3 FROM b WHERE text <> '' AND asr1 <> '' AND asr2 <> ''",
    "p": "SELECT * FROM z UNION ALL SELECT r.model, r.item_id, z.plan_text, r.r_no, r.asr1, r.asr2, r.asr3 FROM r JOIN z ON z.model=r.model AND z.item_id=r.item_id WHERE r.asr1 <> '' AND r.asr2 <> ''",
    "pp": "SELECT *, row_number() OVER (PARTITION BY model, item_id ORDER BY r_no) - 1 AS cand_idx, bool_and(coalesce(asr3,'') <> '') OVER (PARTITION BY model, item_id) AS has3 FROM p"}


@query("s06_candidate_corpus", with_fx("fx_order_text", extra=CORPUS) + "SELECT model, item_id, cand_idx, CASE WHEN r_no >= 0 THEN CAST(r_no AS BIGINT) END AS r_no, plan_text, asr1, asr2, CASE WHEN has3 THEN asr3 END AS asr3 FROM pp")
def s06(spark, sf):
    t = X.order_texts(spark, sf)
    i, c = F.col("item_id"), F.col("cand_idx")
    base = t.where(c == 0).select(*ITEM, F.col("plan_text").alias("text"), F.when(i % 11 != 0, F.col("asr1")).otherwise("").alias("asr1"), "asr2", F.when(i % 6 != 0, F.col("asr3")).alias("asr3"))
    more = t.where(c > 0).select(*ITEM, c.alias("r_no"), "asr1", F.when((i + c) % 5 != 0, F.col("asr2")).alias("asr2"), F.when((i + c) % 17 != 0, F.col("asr3")).alias("asr3"))
    return S.assemble_candidates(base, more)


@query("j13_cache_alignment", with_fx("fx_text", extra={"c": "SELECT item_id AS key, CASE WHEN length(text) % 5 = 0 THEN upper(text) ELSE text END AS cached FROM fx_text WHERE length(text) % 7 <> 0"})
       + "SELECT item_id AS key, CASE WHEN c.key IS NULL THEN 'missing' ELSE 'mismatch' END AS finding FROM fx_text LEFT JOIN c ON c.key=item_id WHERE c.key IS NULL OR c.cached <> text")
def j13(spark, sf):
    s = X.sentences(spark, sf).withColumnRenamed("item_id", "key")
    cached = s.where(F.length("text") % 7 != 0).select("key", F.when(F.length("text") % 5 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return D.alignment(s, cached)


@query("j16_plan_fallback", with_fx("fx_facts", "fx_items", extra={
    "a": "SELECT DISTINCT model, item_id, type, value, polarity FROM fx_facts WHERE condition='SPEAK' AND view='internal'",
    "b": "SELECT DISTINCT model, item_id, type, value, polarity FROM fx_facts WHERE condition='READ' AND view='text'",
    "k": "SELECT DISTINCT model, item_id FROM a"})
 + "SELECT 'resample' AS source, model, type, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'main', model, type, count(*) FROM b ANTI JOIN k USING (model, item_id) GROUP BY ALL")
def j16(spark, sf):
    f = X.facts(spark, sf).distinct()
    a = f.where("condition = 'SPEAK' AND view = 'internal'").select(*ITEM, *P.FACT_KEY)
    b = f.where("condition = 'READ' AND view = 'text'").select(*ITEM, *P.FACT_KEY)
    return U.plan_fallback(b, a, X.items(spark, sf), list(ITEM)).groupBy("source", "model", "type").agg(F.count(F.lit(1)).alias("n"))


PRICE = "CAST(round(o_totalprice) AS BIGINT)"


@query("j11_tolerance_claims", f"""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ({PRICE} * 3) // 1000 || '.' || ({PRICE} % 10) ELSE ({PRICE} % 1000) || '.' || lpad(CAST(({PRICE} * 7) % 100 AS VARCHAR), 2, '0') END AS value FROM orders),
 k AS (SELECT DISTINCT unnest([l_extendedprice, abs(l_extendedprice), abs(l_extendedprice)*100]) AS known FROM lineitem),
 cc AS (SELECT *, CAST(value AS DOUBLE) AS v, 0.5*pow(10.0, -length(split_part(value,'.',2)))+1e-9 AS tol FROM c)
 SELECT c.o_orderkey, c.value, coalesce(abs(p.known - cc.v) < cc.tol, false) OR coalesce(abs(s.known - cc.v) < cc.tol, false) AS explained FROM c JOIN cc USING (o_orderkey)
 LEFT JOIN (SELECT cc.o_orderkey, k.known FROM cc ASOF JOIN k ON cc.v >= k.known) p USING (o_orderkey) LEFT JOIN (SELECT cc.o_orderkey, k.known FROM cc ASOF JOIN k ON cc.v <= k.known) s USING (o_orderkey)""")
def j11(spark, sf):
    price = F.round("o_totalprice").cast("bigint")
    a = F.concat(F.expr("CAST((CAST(round(o_totalprice) AS BIGINT) * 3) div 1000 AS STRING)"), F.lit("."), (price % 10).cast("string"))
    b = F.concat((price % 1000).cast("string"), F.lit("."), F.lpad(((price * 7) % 100).cast("string"), 2, "0"))
    claims = X.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, a).otherwise(b).alias("value"))
    known = D.known_forms(X.table(spark, sf, "lineitem"), "l_extendedprice")
    return D.explained_claims(claims, known)


@query("d10_number_mentions", with_fx("fx_text", extra={"x": r"SELECT item_id, regexp_extract_all(' ' || text || ' ', '[^A-Za-z0-9_.]([0-9]+\.[0-9]+)[^A-Za-z0-9_]', 1) AS v FROM fx_text"})
       + "SELECT DISTINCT item_id AS line, unnest(v) AS value FROM x")
def d10(spark, sf):
    return D.number_mentions(X.sentences(spark, sf), "text", "item_id").withColumnRenamed("item_id", "line")


@query("j12_whitelist", with_fx("fx_text", extra={"x": r"SELECT DISTINCT unnest(regexp_extract_all(' ' || text || ' ', '[^A-Za-z0-9_.]([0-9]+\.[0-9]+)[^A-Za-z0-9_]', 1)) AS value FROM fx_text",
    "w": "SELECT DISTINCT CAST(n_nationkey AS VARCHAR) || '.5' AS value FROM nation"}) + "SELECT value FROM x WHERE value NOT IN (SELECT value FROM w)")
def j12(spark, sf):
    found = D.number_mentions(X.sentences(spark, sf), "text", "item_id")
    allowed = X.table(spark, sf, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".5")).alias("value"))
    return D.unlisted(found, allowed)


# ---- selection with texts ------------------------------------------------------------------

METHODS = ["plan_guided", "fact_consistency", "transcript", "plan_text", "fact_consistency_length"]
TEXT_CTE = {**sql_counts(),
    "ot": f"SELECT model, item_id, cand_idx, asr1 AS r1, asr2 AS r2, asr3 AS r3, {O.normalise('plan_text')} AS pn, {O.normalise('asr1')} AS n1, {O.normalise('asr2')} AS n2, {O.normalise('asr3')} AS n3 FROM fx_order_text",
    "sim": "SELECT model, item_id, cand_idx, " + ", ".join(f"{O.similarity(O.tokens('pn'), O.tokens(f'n{k}'))} AS p_asr{k}" for k in (1, 2, 3)) + ", "
    + ", ".join(f"{O.similarity(O.tokens(f'lower(r{a})'), O.tokens(f'lower(r{b})'))} AS t_asr{a}_asr{b}" for a, b in ((1, 2), (1, 3), (2, 3))) + " FROM ot",
    "md": "SELECT model, item_id, median(duration) AS mid FROM fx_durations WHERE duration IS NOT NULL GROUP BY ALL",
    "lp": "SELECT d.model, d.item_id, d.cand_idx, CASE WHEN mid IS NULL OR duration IS NULL OR mid <= 0 THEN 0.0 ELSE greatest(0.0, (duration-mid)/mid) END AS length_penalty FROM fx_durations d LEFT JOIN md ON md.model=d.model AND md.item_id=d.item_id",
    "full_": "SELECT * FROM cands JOIN sim USING (model, item_id, cand_idx) JOIN lp USING (model, item_id, cand_idx)",
    **sql_folds(METHODS, source="full_")}
FXT = (*FXC, "fx_order_text", "fx_durations")


def text_counts(spark, sf):
    sims = S.text_scores(X.order_texts(spark, sf))
    return counts(spark, sf).join(sims, list(S.CAND)).join(S.length_penalty(X.durations(spark, sf)), list(S.CAND))


@query("w06_selector_methods", with_fx(*FXT, extra=TEXT_CTE) + "SELECT model, item_id, evaluator, base_gap, random_gap, oracle_gap, " + ", ".join(f"{m}_pick, {m}_gap" for m in METHODS) + " FROM picks")
def w06(spark, sf):
    p = S.select_folds(text_counts(spark, sf), METHODS)
    return p.select("model", "item_id", "evaluator", "base_gap", "random_gap", "oracle_gap", *[c for m in METHODS for c in (f"{m}_pick", f"{m}_gap")])


@query("w07_length_penalty", with_fx("fx_durations", extra={k: TEXT_CTE[k] for k in ("md", "lp")}) + "SELECT model, item_id, cand_idx, round(length_penalty, 6) AS length_penalty FROM lp")
def w07(spark, sf):
    return S.length_penalty(X.durations(spark, sf)).select(*S.CAND, r6(F.col("length_penalty")).alias("length_penalty"))


@query("w08_random_pick", with_fx(*FXC, extra={**sql_counts(), **sql_folds(["plan_guided"]),
    "rp": "SELECT model, item_id, evaluator, n_up, CAST(('0x' || substr(md5(concat_ws(':', 20260918, evaluator, item_id)), 1, 15)) AS BIGINT) % n_candidates AS random_pick FROM picks"})
 + "SELECT r.model, r.item_id, r.evaluator, random_pick, 1.0 - CAST(CASE evaluator WHEN 'asr1' THEN i_asr1 WHEN 'asr2' THEN i_asr2 ELSE i_asr3 END AS DOUBLE)/r.n_up AS random_pick_gap FROM rp r JOIN cands c ON c.model=r.model AND c.item_id=r.item_id AND c.cand_idx=random_pick")
def w08(spark, sf):
    return S.random_pick(pools(spark, sf)).select("model", "item_id", "evaluator", "random_pick", "random_pick_gap")


GAINS = {**{f"reduction_{m}": f"base_gap - {m}_gap" for m in METHODS}, "plan_minus_consistency": "fact_consistency_gap - plan_guided_gap",
         "plan_minus_plantext": "plan_text_gap - plan_guided_gap"}


@query("w09_fold_report", with_fx(*FXT, extra={**TEXT_CTE, **sql_paired("picks", "model", "item_id", "evaluator", list(VIEWS), GAINS, B1, 17, rule="nearest"),
    "fr": "SELECT model, evaluator, count(*) AS n_items, round(avg(base_gap),6) AS loss_original, round(avg(random_gap),6) AS loss_random, round(avg(oracle_gap),6) AS loss_oracle, "
       + ", ".join(f"round(avg({m}_gap),6) AS loss_{m}, round(avg(base_gap-{m}_gap),6) AS reduction_{m}, round(avg(CASE WHEN {m}_pick=0 THEN 1.0 ELSE 0.0 END),6) AS picked_original_{m}, round(avg(CASE WHEN {m}_pick=plan_guided_pick THEN 1.0 ELSE 0.0 END),6) AS same_pick_{m}" for m in METHODS)
       + ", round(avg(fact_consistency_gap-plan_guided_gap),6) AS plan_minus_consistency, round(avg(plan_text_gap-plan_guided_gap),6) AS plan_minus_plantext FROM picks GROUP BY model, evaluator",
    "ci": f"SELECT model, evaluator, {sql_wide(list(GAINS))} FROM pci GROUP BY model, evaluator"}) + "SELECT * FROM fr JOIN ci USING (model, evaluator)")
def w09(spark, sf):
    picks = materialise(S.select_folds(text_counts(spark, sf), METHODS))
    ci = R.fold_intervals(picks, METHODS, replicates=B1, seed=17, rule="nearest")
    return R.fold_report(picks, METHODS).join(wide(ci, ["model", "evaluator"], list(GAINS)), ["model", "evaluator"])


TYPED_CTE = dict(TEXT_CTE)
_typed = sql_counts(by_type=True)
TYPED_CTE.update({"ccT": _typed["cc"], "upT": _typed["up"], "tc": _typed["cands"].replace("JOIN up u", "JOIN upT u").replace("LEFT JOIN cc ON", "LEFT JOIN ccT cc ON"),
    "want": "SELECT model, item_id, evaluator, plan_text_pick <> plan_guided_pick AS different, 0 AS p0, plan_text_pick AS p1, plan_guided_pick AS p2 FROM picks",
    "j": " UNION ALL ".join(f"SELECT w.model, w.item_id, w.evaluator, w.different, '{m}' AS method, t.type, t.n_up, CASE evaluator WHEN 'asr1' THEN i_asr1 WHEN 'asr2' THEN i_asr2 ELSE i_asr3 END AS kept FROM want w JOIN tc t ON t.model=w.model AND t.item_id=w.item_id AND t.cand_idx=w.p{k}" for k, m in enumerate(S.METHODS3)),
    "jj": "SELECT * FROM j UNION ALL SELECT * REPLACE ('overall' AS type) FROM j",
    "ls": "SELECT model, item_id, evaluator, type, bool_or(different) AS different, CAST(sum(n_up) FILTER (method='original') AS BIGINT) AS n_up, " + ", ".join(f"1.0-CAST(sum(kept) FILTER (method='{m}') AS DOUBLE)/CAST(sum(n_up) FILTER (method='{m}') AS DOUBLE) AS {m}" for m in S.METHODS3) + " FROM jj GROUP BY model, item_id, evaluator, type",
    "qq": "SELECT model, item_id, type, max(n_up) AS n_up, count(*) FILTER (different) AS nd, " + ", ".join(f"avg({m}) AS {m}, avg({m}) FILTER (different) AS c_{m}" for m in S.METHODS3) + " FROM ls GROUP BY model, item_id, type HAVING count(DISTINCT evaluator) = 3"})


def typed(spark, sf):
    picks = materialise(S.select_folds(text_counts(spark, sf), METHODS))
    return picks, S.typed_losses(picks, pools(spark, sf, by_type=True))


GAIN3 = {k: f"round({x}, 12)" for k, x in (
    ("original_minus_fact", "original - plan_fact"), ("text_minus_fact", "plan_text - plan_fact"), ("conditional_text_minus_fact", "c_plan_text - c_plan_fact"))}


@query("w13_selection_by_type", with_fx(*FXT, extra={**TYPED_CTE, **sql_paired("qq", "model", "item_id", "type", [*FACT_TYPES, "overall"], GAIN3, B1, 19, sparse=("conditional_text_minus_fact",)),
    "ci": f"SELECT model, type, {sql_wide(list(GAIN3))} FROM pci GROUP BY model, type", "sm": """SELECT model, type, count(*) AS n_questions, CAST(sum(n_up) AS BIGINT) AS n_upstream_facts, round(avg(original),6) AS loss_original, round(avg(plan_text),6) AS loss_plan_text, round(avg(plan_fact),6) AS loss_plan_fact,
 round(avg(original-plan_fact),6) AS original_minus_fact, round(avg(plan_text-plan_fact),6) AS text_minus_fact,
 count(*) FILTER (original-plan_fact > 1e-12) AS original_improved, count(*) FILTER (abs(original-plan_fact) <= 1e-12) AS original_unchanged, count(*) FILTER (original-plan_fact < -1e-12) AS original_worsened,
 count(*) FILTER (plan_text-plan_fact > 1e-12) AS text_improved, count(*) FILTER (abs(plan_text-plan_fact) <= 1e-12) AS text_unchanged, count(*) FILTER (plan_text-plan_fact < -1e-12) AS text_worsened,
 count(*) FILTER (nd > 0) AS n_disagreeing, CAST(sum(nd) AS BIGINT) AS n_disagreeing_folds, round(avg(c_plan_text-c_plan_fact),6) AS conditional_text_minus_fact FROM qq GROUP BY model, type"""}) + "SELECT * FROM sm JOIN ci USING (model, type)")
def w13(spark, sf):
    losses = materialise(typed(spark, sf)[1])
    out = S.question_summary(losses)
    ci = wide(S.question_intervals(losses, [*FACT_TYPES, "overall"], replicates=B1, seed=19), ["model", "type"], list(GAIN3))
    return rounded(out, [c for c in out.columns if c.startswith(("loss_", "conditional")) or c.endswith("_minus_fact")]).join(ci, ["model", "type"])


@query("w14_selection_violations", with_fx(*FXT, extra=TYPED_CTE) + "SELECT model, item_id, evaluator, 'loss mismatch' AS rule FROM picks WHERE item_id % 29 = 0")
def w14(spark, sf):
    picks, losses = typed(spark, sf)
    losses = materialise(losses)
    shifted = F.when(F.col("item_id") % 29 == 0, F.col("base_gap") + 0.01).otherwise(F.col("base_gap"))
    return S.selection_violations(picks.withColumn("base_gap", shifted).select(*ITEM, "evaluator", "base_gap", "plan_text_gap", "plan_guided_gap"), losses)


E4_METHODS = ("original", "plan_guided", "fact_consistency", "oracle")
ANS = "regexp_extract({t}, '(?i)order ([0-9]+)', 1)"


@query("w15_downstream_accuracy", with_fx(*FXT, extra={**TEXT_CTE,
    "w": " UNION ALL ".join(f"SELECT model, item_id, evaluator, '{m}' AS method, {'0' if m == 'original' else m + '_pick'} AS pick, {'base_gap' if m == 'original' else m + '_gap'} AS gap FROM picks" for m in E4_METHODS),
    "a": f"SELECT w.*, CASE evaluator WHEN 'asr1' THEN r1 WHEN 'asr2' THEN r2 ELSE r3 END AS t FROM w JOIN ot ON ot.model=w.model AND ot.item_id=w.item_id AND ot.cand_idx=w.pick",
    "g": f"SELECT *, coalesce({O.numeric_equal(O.numeric_answer('t'), chr(39) + '12' + chr(39))}, false) AS correct FROM a",
    "b": "SELECT model, item_id, evaluator, gap AS g0, correct AS c0 FROM g WHERE method='original'"})
 + """SELECT g.model, g.evaluator, g.method, count(*) AS n_items, round(avg(gap),6) AS plan_loss, round(avg(g0-gap),6) AS loss_reduction, CAST(count(*) FILTER (correct) AS DOUBLE)/count(*) AS accuracy,
 round(avg(CAST(correct AS INT)-CAST(c0 AS INT)),6) AS accuracy_delta FROM g JOIN b USING (model, item_id, evaluator) GROUP BY g.model, g.evaluator, g.method""")
def w15(spark, sf):
    picks = S.select_folds(text_counts(spark, sf), METHODS)
    texts = X.order_texts(spark, sf).select(*ITEM, F.col("cand_idx").cast("bigint").alias("pick"), *VIEWS)
    return rounded(R.downstream_accuracy(picks, texts, E4_METHODS, gold="12"), ["plan_loss", "loss_reduction", "accuracy_delta"])


@query("w16_view_availability", with_fx("fx_order_text", extra={"v": "SELECT 'asr1' AS view, asr1 <> '' AND item_id % 3 <> 0 AS ok FROM fx_order_text UNION ALL SELECT 'asr2', item_id % 7 = 0 FROM fx_order_text UNION ALL SELECT 'asr3', TRUE FROM fx_order_text"})
       + "SELECT view, count(*) AS n, count(*) FILTER (ok) AS n_present, CAST(count(*) FILTER (ok) AS DOUBLE)/count(*) AS coverage, CAST(count(*) FILTER (ok) AS DOUBLE)/count(*) >= 0.5 AS available FROM v GROUP BY view")
def w16(spark, sf):
    t = X.order_texts(spark, sf)
    i = F.col("item_id")
    rows = F.array(F.struct(F.lit("asr1").alias("view"), ((F.col("asr1") != "") & (i % 3 != 0)).alias("present")),
                   F.struct(F.lit("asr2").alias("view"), (i % 7 == 0).alias("present")), F.struct(F.lit("asr3").alias("view"), F.lit(True).alias("present")))
    return S.view_availability(t.select(F.explode(rows).alias("r")).select("r.view", "r.present"))


@query("w17_last_writer", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def w17(spark, sf):
    e = X.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("o"))
    return MG.last_per_key(e, ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id", "value")


@query("d02_candidate_validation", with_fx("fx_order_text", extra={
    "c": "SELECT *, CASE WHEN (item_id + cand_idx) % 31 = 0 THEN plan_text || '!' ELSE ' ' || plan_text END AS text, CASE WHEN (item_id + cand_idx) % 7 <> 0 THEN asr3 END AS a3 FROM fx_order_text WHERE (item_id + cand_idx) % 41 <> 0",
    "j": "SELECT g.model, c.item_id IS NOT NULL AS there, c.item_id IS NOT NULL AND c.a3 IS NOT NULL AS three, c.item_id IS NOT NULL AND trim(c.text) = trim(g.plan_text) AS same FROM fx_order_text g LEFT JOIN c ON c.model=g.model AND c.item_id=g.item_id AND c.cand_idx=g.cand_idx"})
 + "SELECT model, count(*) AS expected, count(*) FILTER (there) AS n_present, count(*) FILTER (three) AS n_complete, count(*) FILTER (same) AS n_text_matches, bool_and(there AND three AND same) AS ready FROM j GROUP BY model")
def d02(spark, sf):
    t = X.order_texts(spark, sf)
    k = F.col("item_id") + F.col("cand_idx")
    c = t.where(k % 41 != 0).select(*S.CAND, F.when(k % 31 == 0, F.concat("plan_text", F.lit("!"))).otherwise(F.concat(F.lit(" "), "plan_text")).alias("text"),
                                    "asr1", "asr2", F.when(k % 7 != 0, F.col("asr3")).alias("asr3"))
    base = t.where("cand_idx = 0").select(*ITEM, F.col("plan_text").alias("text"))
    return D.candidate_validation(t.select(*S.CAND), c, base)


#: Retold plans: one in twenty in lower case, the others with a trailing blank.
RETOLD = "SELECT model, item_id, cand_idx, plan_text, CASE WHEN (item_id * 3 + cand_idx) % 20 = 0 THEN lower(plan_text) ELSE plan_text || ' ' END AS text FROM fx_order_text"


@query("j10_identical_text_items", with_fx("fx_order_text") + "SELECT model, item_id, count(*) AS n_matches FROM fx_order_text GROUP BY model, item_id HAVING bool_and((item_id * 3 + cand_idx) % 20 <> 0)")
def j10(spark, sf):
    t = X.order_texts(spark, sf)
    c = t.select(*ITEM, F.when((F.col("item_id") * 3 + F.col("cand_idx")) % 20 == 0, F.lower("plan_text")).otherwise(F.concat("plan_text", F.lit(" "))).alias("text"))
    return D.identical_text_items(c, t.where("cand_idx = 0").select(*ITEM, F.col("plan_text").alias("text")))


@query("d09_readback_coverage", with_fx("fx_order_text") + "SELECT cand_idx AS r_no, count(*) AS n_files, count(*) FILTER (trim(asr1) <> '') AS asr1, count(*) FILTER (trim(asr2) <> '' AND item_id % 4 <> 0) AS asr2, count(*) FILTER (trim(asr3) <> '') AS asr3 FROM fx_order_text GROUP BY cand_idx")
def d09(spark, sf):
    t = X.order_texts(spark, sf).withColumnRenamed("cand_idx", "r_no")
    return D.coverage_by_number(t.withColumn("asr2", F.when(F.col("item_id") % 4 != 0, F.col("asr2"))))


# ---- audit ---------------------------------------------------------------------------------

STRATA_CTE = {"ok": f"SELECT model, item_id FROM fx_items i WHERE {sql_seen('SPEAK', ('asr1', 'asr2', 'asr3'), 'i')}",
    "sig": "SELECT model, item_id, view, list_sort(list(type || '|' || value || '|' || polarity)) AS s FROM fx_facts WHERE condition='SPEAK' AND view IN ('asr1','asr2','asr3') GROUP BY model, item_id, view",
    "w3": """SELECT ok.model, ok.item_id, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b, coalesce(c.s, []) AS c FROM ok LEFT JOIN sig a ON a.model=ok.model AND a.item_id=ok.item_id AND a.view='asr1'
 LEFT JOIN sig b ON b.model=ok.model AND b.item_id=ok.item_id AND b.view='asr2' LEFT JOIN sig c ON c.model=ok.model AND c.item_id=ok.item_id AND c.view='asr3'""",
    "cand": """SELECT 'r' || CAST(item_id % 2 AS VARCHAR) AS run_id, model, item_id,
 (['content','number','unit','negation','proper_noun'])[CAST(item_id % 5 AS INT) * 2 % 5 + 1] AS category, 'a/' || item_id || '.wav' AS audio,
 CASE WHEN a=b AND b=c THEN 'all_three_agree' WHEN a=b OR a=c OR b=c THEN 'two_agree' ELSE 'all_differ' END AS stratum FROM w3"""}
FXA = ("fx_facts", "fx_observed", "fx_items")
SEED = 20260918


def audit_pool(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("content", "number", "unit", "negation", "proper_noun")])
    i = F.col("item_id")
    return j08(spark, sf).select(
        F.concat(F.lit("r"), (i % 2).cast("string")).alias("run_id"), "model", "item_id",
        F.element_at(kinds, ((i % 5) * 2 % 5 + 1).cast("int")).alias("category"), F.concat(F.lit("a/"), i.cast("string"), F.lit(".wav")).alias("audio"), "stratum")


ENRICHED_CTE = {**STRATA_CTE,
    "e1": f"SELECT *, sha256(concat_ws(':', {SEED}, model || ',' || category, run_id, item_id)) AS h, sha256(concat_ws(':', {SEED}, 'fill', run_id, model, item_id)) AS f FROM cand",
    "e2": "SELECT *, row_number() OVER (PARTITION BY stratum, model, category ORDER BY h DESC) AS rn FROM e1",
    "e3": "SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rn, model, category) AS turn FROM e2",
    "chosen": "SELECT * FROM e3 WHERE turn <= CASE stratum WHEN 'all_differ' THEN 40 WHEN 'two_agree' THEN 35 ELSE 25 END",
    "restr": "SELECT * FROM e3 ANTI JOIN chosen USING (run_id, model, item_id)",
    "sel": "SELECT * FROM (SELECT run_id, model, item_id, category, audio, stratum, 0 AS late, '' AS f FROM chosen UNION ALL SELECT run_id, model, item_id, category, audio, stratum, 1, f FROM restr) ORDER BY late, f, run_id, model, item_id LIMIT 100",
    "pk": "SELECT run_id, model, item_id, category, audio, stratum, 'three_asr_' || lpad(CAST(row_number() OVER (ORDER BY stratum, model, category, item_id) AS VARCHAR), 3, '0') AS audit_id FROM sel"}


@query("u02_enriched_sample", with_fx(*FXA, extra=ENRICHED_CTE) + "SELECT * FROM pk")
def u02(spark, sf):
    return U.enriched_sample(audit_pool(spark, sf), 100, SEED)


def master_packet(spark, sf):
    """The sample as a written table: sheets and merges read it many times."""
    return materialise(u02(spark, sf))


PROP_CTE = {**STRATA_CTE,
    "sw": "SELECT stratum, count(*) AS w FROM cand GROUP BY stratum",
    "s1": "SELECT *, 60*CAST(w AS DOUBLE)/(SELECT sum(w) FROM sw) AS ex FROM sw",
    "s2": "SELECT *, CAST(floor(ex) AS BIGINT) AS b, row_number() OVER (ORDER BY ex-floor(ex) DESC, stratum) AS o, 60 - sum(CAST(floor(ex) AS BIGINT)) OVER () AS l FROM s1",
    "s3": "SELECT stratum, b + CASE WHEN o <= l THEN 1 ELSE 0 END AS amount FROM s2",
    "mw": "SELECT stratum, model, count(*) AS w FROM cand GROUP BY stratum, model",
    "m1": "SELECT mw.*, amount, CAST(amount AS DOUBLE)*w/sum(w) OVER (PARTITION BY stratum) AS ex FROM mw JOIN s3 USING (stratum)",
    "m2": "SELECT *, CAST(floor(ex) AS BIGINT) AS b, row_number() OVER (PARTITION BY stratum ORDER BY ex-floor(ex) DESC, model) AS o, amount - sum(CAST(floor(ex) AS BIGINT)) OVER (PARTITION BY stratum) AS l FROM m1",
    "m3": "SELECT stratum, model, b + CASE WHEN o <= l THEN 1 ELSE 0 END AS quota FROM m2",
    "rk": "SELECT *, row_number() OVER (PARTITION BY stratum, model ORDER BY sha256(concat_ws(':', 20260922, run_id, item_id)), run_id, item_id) AS rn FROM cand"}


@query("u03_proportional_sample", with_fx(*FXA, extra=PROP_CTE) + "SELECT run_id, rk.model, item_id, category, audio, rk.stratum FROM rk JOIN m3 ON m3.stratum=rk.stratum AND m3.model=rk.model WHERE rn <= quota")
def u03(spark, sf):
    return U.proportional_sample(audit_pool(spark, sf), 60, 20260922)


@query("u04_fixed_per_group", "SELECT o_orderpriority AS task, o_orderkey AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(concat_ws(':', 20260922, o_orderkey)), o_orderkey) AS rn FROM orders) WHERE rn <= 75")
def u04(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("item_id"))
    return U.fixed_per_group(rows, ["task"], 75, 20260922, "item_id").orderBy("item_id")


@query("u05_text_sample", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', 5, doc_id)), doc_id) AS rn FROM documents WHERE trim(text) <> '') WHERE rn <= 12")
def u05(spark, sf):
    rows = X.table(spark, sf, "documents").where("trim(text) <> ''").select("lang", "doc_id")
    return U.fixed_per_group(rows, ["lang"], 12, 5, "doc_id")


@query("u06_blinded_sheet", with_fx(*FXA, extra=ENRICHED_CTE) + "SELECT audit_id, audio, CAST(NULL AS VARCHAR) AS transcript, CAST(NULL AS VARCHAR) AS notes, sha256(concat_ws(':', 1, 'annotator_1', audit_id)) AS sort_key FROM pk")
def u06(spark, sf):
    return U.blind_sheet(u02(spark, sf), "annotator_1", 1)


def annotated(master, flavour: int):
    fact = lambda v: F.struct(F.lit("number").alias("type"), v.alias("value"), F.lit("+").alias("polarity"))
    v = F.col("item_id").cast("string")
    text = F.concat(F.lit("order "), v, F.lit(" costs 12" if flavour == 1 else " cost 12"))
    facts = F.when(F.col("item_id") % 3 == flavour, F.array(fact(v))).otherwise(F.array(fact(v), fact(F.lit("12"))))
    return master.select("audit_id", "audio", text.alias("transcript"), facts.alias("facts"))


@query("u07_sheet_violations", with_fx(*FXA, extra=ENRICHED_CTE) + """SELECT audit_id, 'audio changed' AS rule FROM pk WHERE item_id % 7 = 0 UNION ALL SELECT audit_id, 'no transcript' FROM pk WHERE item_id % 7 = 1
 UNION ALL SELECT audit_id, 'invalid fact' FROM pk WHERE item_id % 7 = 2 UNION ALL SELECT audit_id, 'duplicate id' FROM pk WHERE item_id % 7 = 3 UNION ALL SELECT audit_id, 'missing id' FROM pk WHERE item_id % 7 = 4
 UNION ALL SELECT 'x' || audit_id, 'unknown id' FROM pk WHERE item_id % 7 = 4""")
def u07(spark, sf):
    m = master_packet(spark, sf)
    k = F.col("item_id") % 7
    s = m.join(annotated(m, 1).drop("audio"), "audit_id")
    bad = F.array(F.struct(F.lit("number").alias("type"), F.lit(" ").alias("value"), F.lit("+").alias("polarity")))
    sheet = s.select(
        F.when(k == 4, F.concat(F.lit("x"), "audit_id")).otherwise(F.col("audit_id")).alias("audit_id"), F.when(k == 0, "other.wav").otherwise(F.col("audio")).alias("audio"),
        F.when(k != 1, F.col("transcript")).alias("transcript"), F.when(k == 2, bad).otherwise(F.col("facts")).alias("facts"), F.expr("explode(sequence(1, IF(item_id % 7 = 3, 2, 1)))").alias("i")).drop("i")
    return U.sheet_violations(m, sheet)


HUMAN_CTE = {**ENRICHED_CTE, "lab": "SELECT audit_id, audio, item_id, 'order ' || item_id || ' costs 12' AS t1, 'order ' || item_id || ' cost 12' AS t2, CASE WHEN item_id % 3 = 1 THEN 1 ELSE 2 END AS n1, CASE WHEN item_id % 3 = 2 THEN 1 ELSE 2 END AS n2 FROM pk"}


@query("u08_merge_annotators", with_fx(*FXA, extra=HUMAN_CTE) + "SELECT audit_id, t1, t2, n1, n2 FROM lab")
def u08(spark, sf):
    m = master_packet(spark, sf)
    both = U.merge_annotators(m.select("audit_id", "audio", "item_id"), annotated(m, 1), annotated(m, 2))
    return both.select("audit_id", F.col("annotator_1.transcript").alias("t1"), F.col("annotator_2.transcript").alias("t2"),
                       F.size("annotator_1.facts").alias("n1"), F.size("annotator_2.facts").alias("n2"))


@query("u09_adjudication_sheet", with_fx(*FXA, extra={**HUMAN_CTE, "sw": "SELECT *, CAST(('0x' || substr(sha256(concat_ws(':', 9, 'adjudication', audit_id)), 1, 1)) AS INT) % 2 = 1 AS swap FROM lab"})
       + "SELECT audit_id, audio, CASE WHEN swap THEN t2 ELSE t1 END AS a, CASE WHEN swap THEN t1 ELSE t2 END AS b, sha256(concat_ws(':', 9, 'adjudication-order', audit_id)) AS sort_key FROM sw")
def u09(spark, sf):
    m = master_packet(spark, sf)
    both = U.merge_annotators(m.select("audit_id", "audio", "item_id"), annotated(m, 1), annotated(m, 2))
    s = U.adjudication_sheet(both, 9)
    return s.select("audit_id", "audio", F.col("candidate_a.transcript").alias("a"), F.col("candidate_b.transcript").alias("b"), "sort_key")


@query("u10_merge_adjudication", with_fx(*FXA, extra=HUMAN_CTE) + "SELECT audit_id, t1 AS adjudicated, n1 AS n_facts FROM lab")
def u10(spark, sf):
    m = master_packet(spark, sf)
    return U.merge_adjudication(m.select("audit_id", "audio"), annotated(m, 1)).select(
        "audit_id", F.col("adjudicated.transcript").alias("adjudicated"), F.size("adjudicated.facts").alias("n_facts"))


@query("u11_label_agreement", with_fx("fx_heard", extra={"n": f"SELECT trim(asr1) <> trim(asr2) AS d, {O.normalise('asr1')} AS a, {O.normalise('asr2')} AS b FROM fx_heard", "w": f"SELECT d, {O.wer('a', 'b')} AS w FROM n"})
       + "SELECT count(*) AS n_items, count(*) FILTER (d) AS n_disagreements, round(avg(w),6) AS mean_transcript_wer, 1.0-CAST(count(*) FILTER (d) AS DOUBLE)/count(*) AS agreement_rate FROM w")
def u11(spark, sf):
    t = X.transcripts(spark, sf).select(F.col("asr1").alias("t1"), F.col("asr2").alias("t2"), T.normalize_text("asr1").alias("a"), T.normalize_text("asr2").alias("b"))
    return rounded(U.label_agreement(t.select("t1", "t2", E.wer("a", "b").alias("wer"))), ["mean_transcript_wer"])


@query("u12_packet_checksum")
def u12(spark, sf):
    return U.content_checksum(u02(spark, sf), ["audit_id", "audio", "stratum", "model", "category", "item_id"])


@query("a20_adjudication_scores", with_fx(*FXA, extra=HUMAN_CTE) + """SELECT 'annotators' AS pair, count(*) AS n_items, CAST(sum(least(n1,n2)) AS BIGINT) AS tp, CAST(sum(n1) AS BIGINT) AS predicted, CAST(sum(n2) AS BIGINT) AS gold,
 CAST(sum(least(n1,n2)) AS DOUBLE)/CAST(sum(n1) AS DOUBLE) AS precision, CAST(sum(least(n1,n2)) AS DOUBLE)/CAST(sum(n2) AS DOUBLE) AS recall,
 2.0*(CAST(sum(least(n1,n2)) AS DOUBLE)/CAST(sum(n1) AS DOUBLE))*(CAST(sum(least(n1,n2)) AS DOUBLE)/CAST(sum(n2) AS DOUBLE))/(CAST(sum(least(n1,n2)) AS DOUBLE)/CAST(sum(n1) AS DOUBLE)+CAST(sum(least(n1,n2)) AS DOUBLE)/CAST(sum(n2) AS DOUBLE)) AS f1 FROM lab""")
def a20(spark, sf):
    m = master_packet(spark, sf)
    key = ["audit_id", "type", "value", "polarity"]
    long = lambda k: annotated(m, k).select("audit_id", F.explode("facts").alias("f")).select("audit_id", "f.*").distinct()
    a, b = long(1).withColumn("a", F.lit(1)), long(2).withColumn("b", F.lit(1))
    per = a.join(b, key, "full").groupBy("audit_id").agg(
        _count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count("a").alias("predicted"), F.count("b").alias("gold"))
    return M.precision_recall(per.withColumn("pair", F.lit("annotators")), ["pair"])


@query("a20_completion", with_fx("fx_heard") + """SELECT count(*) AS n_items, count(*) FILTER (asr1 <> '') AS annotator_1, count(*) FILTER (asr2 <> '') AS annotator_2, count(*) FILTER (text <> '') AS adjudicated,
 count(*) = count(*) FILTER (asr1 <> '') AND count(*) = count(*) FILTER (asr2 <> '') AND count(*) = count(*) FILTER (text <> '') AS ready FROM fx_heard""")
def a20c(spark, sf):
    t = X.transcripts(spark, sf).select((F.col("asr1") != "").alias("annotator_1"), (F.col("asr2") != "").alias("annotator_2"), (F.col("text") != "").alias("adjudicated"))
    return U.completion(t, ["annotator_1", "annotator_2", "adjudicated"])


@query("a27_packet_summary", with_fx(*FXA, extra=ENRICHED_CTE) + " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{d}' AS dimension, {d} AS value, count(*) AS n FROM {t} GROUP BY {d}" for s, t in (("candidates", "cand"), ("selected", "pk")) for d in ("stratum", "model", "category")))
def a27(spark, sf):
    pool = audit_pool(spark, sf)
    return U.packet_summary(pool, "candidates").unionByName(U.packet_summary(U.enriched_sample(pool, 100, SEED), "selected"))


@query("a29_stratum_weights", with_fx(*FXA, extra=STRATA_CTE) + "SELECT stratum, count(*) AS n, CAST(count(*) AS DOUBLE)/CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM cand GROUP BY stratum")
def a29(spark, sf):
    return U.stratum_weights(audit_pool(spark, sf))


OBS = ("human", "asr1", "asr2", "asr3")


@query("a28_human_anchor", with_fx(*FXA, extra={**STRATA_CTE,
    "up": "SELECT DISTINCT model, item_id, type, value, polarity FROM fx_facts WHERE condition='SPEAK' AND view='internal'",
    "k": "SELECT u.model, u.item_id, count(*) AS n_plan, " + ", ".join(
        f"count(*) FILTER (EXISTS (SELECT 1 FROM fx_facts d WHERE d.condition='{c}' AND d.view='{v}' AND d.model=u.model AND d.item_id=u.item_id AND d.type=u.type AND d.value=u.value AND d.polarity=u.polarity)) AS k_{o}"
        for o, c, v in (("human", "ECHO", "internal"), ("asr1", "SPEAK", "asr1"), ("asr2", "SPEAK", "asr2"), ("asr3", "SPEAK", "asr3"))) + " FROM up u SEMI JOIN ok USING (model, item_id) GROUP BY u.model, u.item_id",
    "l": " UNION ALL ".join(f"SELECT stratum, '{o}' AS observer, n_plan, k_{o} AS k FROM k JOIN cand USING (model, item_id)" for o in OBS),
    "per": "SELECT stratum, observer, count(*) AS n_items, avg(CAST(k AS DOUBLE)/n_plan) AS item_macro, CAST(sum(k) AS DOUBLE)/CAST(sum(n_plan) AS DOUBLE) AS fact_micro FROM l GROUP BY ALL",
    "wt": "SELECT stratum, CAST(count(*) AS DOUBLE)/CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM cand GROUP BY stratum"})
 + """SELECT stratum AS scope, observer, n_items, round(item_macro,6) AS item_macro, round(fact_micro,6) AS fact_micro FROM per
 UNION ALL SELECT 'all', observer, count(*), round(avg(CAST(k AS DOUBLE)/n_plan),6), round(CAST(sum(k) AS DOUBLE)/CAST(sum(n_plan) AS DOUBLE),6) FROM l GROUP BY observer
 UNION ALL SELECT 'weighted', observer, CAST(sum(n_items) AS BIGINT), round(sum(weight*item_macro)/sum(weight),6), round(sum(weight*fact_micro)/sum(weight),6) FROM per JOIN wt USING (stratum) GROUP BY observer""")
def a28(spark, sf):
    up = planned("SPEAK")
    pairs = [Pair("human", planned("ECHO"), up)] + [Pair(v, P.Side.of("SPEAK", v), up) for v in VIEWS]
    c = P.item_counts(presence(spark, sf), pairs)
    wide = c.groupBy(*ITEM).agg(F.max("total").alias("n_plan"), *[F.max(F.when(F.col("metric") == o, F.col("retained"))).alias(f"k_{o}") for o in OBS])
    pool = audit_pool(spark, sf)
    out = U.human_anchor(wide.join(pool.select(*ITEM, "stratum"), list(ITEM)), U.stratum_weights(pool), OBS)
    return rounded(out, ["item_macro", "fact_micro"])


U1_CTE = {**STRATA_CTE, "pred": "SELECT model, item_id, CASE WHEN item_id % 12 = 0 THEN 'boom' END AS error, CASE WHEN item_id % 10 <> 0 THEN 'a/' || item_id || '.wav' END AS audio, item_id % 14 = 0 AS no3 FROM fx_items"}


@query("u01_audit_candidates", with_fx(*FXA, extra=U1_CTE) + "SELECT p.model, p.item_id, p.audio, c.stratum FROM pred p JOIN cand c ON c.model=p.model AND c.item_id=p.item_id WHERE error IS NULL AND p.audio IS NOT NULL AND NOT no3")
def u01(spark, sf):
    i = F.col("item_id")
    pred = X.items(spark, sf).select(*ITEM, F.when(i % 12 == 0, "boom").alias("error"), F.when(i % 10 != 0, F.concat(F.lit("a/"), i.cast("string"), F.lit(".wav"))).alias("audio"),
                                     F.lit("x").alias("asr1"), F.lit("").alias("asr2"), F.when(i % 14 != 0, "z").alias("asr3"))
    return U.packet(U.audit_candidates(pred, j08(spark, sf))).select("model", "item_id", "audio", "stratum")


# ---- consistency ---------------------------------------------------------------------------

@query("d07_crosscheck", SQL_A03 + """, now_ AS (SELECT model, metric, 1.0-CAST(retained AS DOUBLE)/CAST(total AS DOUBLE) AS gap FROM pooled)
 SELECT model, metric, gap AS now, CASE WHEN metric = 'echo' THEN gap + 0.001 END AS saved, CASE WHEN metric = 'echo' THEN 'differs' ELSE 'not stored' END AS finding FROM now_ WHERE metric IN ('echo', 'forced')""")
def d07(spark, sf):
    now = M.headline(presence(spark, sf), observed_flags(spark, sf))
    stored = now.where("metric <> 'forced'").withColumn("gap", F.when(F.col("metric") == "echo", F.col("gap") + 0.001).otherwise(F.col("gap")))
    return D.crosscheck(now, stored, ["model", "metric"], "gap")


@query("d08_snapshot_diff", SQL_A03 + """SELECT model, metric, 'total' AS field, CAST(CAST(total AS BIGINT) AS VARCHAR) AS previous, CAST(CAST(total AS BIGINT) + 1 AS VARCHAR) AS current, false AS allowed FROM pooled WHERE metric='perception'
 UNION ALL SELECT model, metric, 'retained', CAST(CAST(retained AS BIGINT) AS VARCHAR), CAST(CAST(retained AS BIGINT) * 2 AS VARCHAR), true FROM pooled WHERE metric='echo'""")
def d08(spark, sf):
    now = M.headline(presence(spark, sf), observed_flags(spark, sf)).select("model", "metric", "retained", "total")
    later = now.withColumn("total", F.when(F.col("metric") == "perception", F.col("total") + 1).otherwise(F.col("total"))).withColumn(
        "retained", F.when(F.col("metric") == "echo", F.col("retained") * 2).otherwise(F.col("retained")))
    return D.snapshot_diff(now, later, ["model", "metric"], ["retained", "total"], ["total"])


@query("a08_verdict", _decomposition_sql(["asr1"]).rstrip() + f""", fx_order_text AS ({FX["fx_order_text"][1]}), g AS (SELECT model, metric, 1.0-CAST(retained AS DOUBLE)/CAST(total AS DOUBLE) AS gap FROM pooled WHERE metric IN ('comply_EF','render_EF','render_SPEAK')),
 w AS (SELECT model, max(gap) FILTER (metric='comply_EF') AS c, max(gap) FILTER (metric='render_EF') AS e, max(gap) FILTER (metric='render_SPEAK') AS s FROM g GROUP BY model),
 same AS (SELECT DISTINCT model, item_id FROM fx_order_text WHERE cand_idx = 0 AND {O.normalise('plan_text')} = {O.normalise('asr1')}),
 a AS (SELECT DISTINCT model, item_id, type, value, polarity FROM fx_facts WHERE condition='READ' AND view='text'), b AS (SELECT DISTINCT model, item_id, type, value, polarity FROM fx_facts WHERE condition='EF' AND view='internal'),
 na AS (SELECT model, item_id, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT model, item_id, count(*) AS n FROM b GROUP BY ALL), nab AS (SELECT model, item_id, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY ALL),
 f AS (SELECT same.model, CASE WHEN coalesce(na.n,0) > 0 THEN 1.0-CAST(coalesce(nab.n,0) AS DOUBLE)/na.n WHEN coalesce(nb.n,0) > 0 THEN 0.0 END AS l FROM same LEFT JOIN na USING (model, item_id) LEFT JOIN nb USING (model, item_id) LEFT JOIN nab USING (model, item_id)),
 fl AS (SELECT model, avg(l) AS floor FROM f GROUP BY model)
 SELECT model, round(floor,6) AS floor, CASE WHEN abs(e-s) <= greatest(floor, 0.02) THEN 'C' WHEN c <= floor + 0.05 THEN 'B' ELSE 'A' END AS verdict FROM w JOIN fl USING (model)""")
def a08(spark, sf):
    p = presence(spark, sf)
    t = X.order_texts(spark, sf).where("cand_idx = 0")
    same = t.where(T.normalize_text("plan_text") == T.normalize_text("asr1")).select(*ITEM).distinct()
    floor = M.noise_floor(p, same).select("model", "floor")
    return M.verdict(M.decomposition(p, observed_flags(spark, sf)), floor).select("model", r6(F.col("floor")).alias("floor"), "verdict")


# Length analysis: words of the order texts as plan lengths, line quantities as durations.
LEN_CTE = {"ln": "SELECT item_id, model, (item_id * 37) % 23 + 3 AS w_echo, (item_id * 41) % 19 + 4 AS w_speak, CASE WHEN item_id % 8 <> 0 THEN CAST((item_id * 29) % 40 AS DOUBLE) / 2 END AS dur FROM fx_items",
    "c": " UNION ALL ".join(f"SELECT '{c}' AS condition, u.model, u.item_id, count(d.value) AS r, count(*) AS t FROM (SELECT DISTINCT model,item_id,type,value,polarity FROM fx_facts WHERE condition='{c}' AND view='internal') u LEFT JOIN (SELECT DISTINCT model,item_id,type,value,polarity FROM fx_facts WHERE condition='{c}' AND view='asr1') d USING (model,item_id,type,value,polarity) GROUP BY u.model, u.item_id" for c in ("SPEAK", "ECHO"))}


def lengths(spark, sf):
    i = F.col("item_id")
    return X.items(spark, sf).select(*ITEM, ((i * 37) % 23 + 3).alias("w_echo"), ((i * 41) % 19 + 4).alias("w_speak"),
                                     F.when(i % 8 != 0, ((i * 29) % 40).cast("double") / 2).alias("dur"))


@query("a12_length_table", with_fx("fx_facts", "fx_items", extra=LEN_CTE) + """SELECT condition, n_items, round(mean_words,6) AS mean_words, round(mean_duration,6) AS mean_duration, 1.0-CAST(r AS DOUBLE)/CAST(t AS DOUBLE) AS render_gap FROM (
 SELECT condition, count(*) AS n_items, avg(CASE WHEN condition='ECHO' THEN w_echo ELSE w_speak END) AS mean_words, avg(nullif(dur,0)) AS mean_duration, sum(coalesce(r,0)) AS r, sum(coalesce(t,0)) AS t
 FROM (SELECT ln.*, x.condition, c.r, c.t FROM ln CROSS JOIN (VALUES ('SPEAK'),('ECHO')) x(condition) LEFT JOIN c ON c.condition=x.condition AND c.model=ln.model AND c.item_id=ln.item_id) GROUP BY condition)""")
def a12(spark, sf):
    return rounded(R.length_table(lengths(spark, sf), presence(spark, sf)), ["mean_words", "mean_duration"])


@query("a13_length_matched", with_fx("fx_facts", "fx_items", extra={**LEN_CTE,
    "m": "SELECT ln.model, (1.0-CAST(e.r AS DOUBLE)/e.t) - (1.0-CAST(s.r AS DOUBLE)/s.t) AS d FROM ln JOIN c e ON e.condition='ECHO' AND e.model=ln.model AND e.item_id=ln.item_id JOIN c s ON s.condition='SPEAK' AND s.model=ln.model AND s.item_id=ln.item_id WHERE abs(w_echo-w_speak) <= 0.15*greatest(w_echo,w_speak)",
    "r": "SELECT *, row_number() OVER (PARTITION BY model ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM m"})
 + "SELECT model, count(*) AS n_matched, round(avg(d),6) AS mean_diff, max(d) FILTER (i = n // 2) AS median_diff, CAST(count(*) FILTER (d > 0) AS DOUBLE)/count(*) AS frac_echo_worse FROM r GROUP BY model")
def a13(spark, sf):
    return rounded(R.length_matched(lengths(spark, sf), presence(spark, sf)), ["mean_diff"])


# ---- marts ---------------------------------------------------------------------------------

@query("r01_path_mart", _decomposition_sql(["asr1", "asr2", "asr3", "union123"]).rstrip() + """, g AS (SELECT model, mode, metric, 1.0-CAST(retained AS DOUBLE)/nullif(CAST(total AS DOUBLE),0) AS gap FROM pooled)
 SELECT model, max(gap) FILTER (mode='asr1' AND metric='plan') AS plan, max(gap) FILTER (mode='asr1' AND metric='render_SPEAK') AS render_asr1, max(gap) FILTER (mode='asr2' AND metric='render_SPEAK') AS render_asr2,
 max(gap) FILTER (mode='asr3' AND metric='render_SPEAK') AS render_asr3, max(gap) FILTER (mode='union123' AND metric='render_SPEAK') AS render_union FROM g GROUP BY model""")
def r01(spark, sf):
    return R.path_mart(M.decomposition(presence(spark, sf), observed_flags(spark, sf), ["asr1", "asr2", "asr3", "union123"]))


@query("r02_selection_mart", with_fx(*FXT, extra={**TEXT_CTE,
    "f": "SELECT model, evaluator, avg(base_gap) AS original, avg(random_gap) AS random, avg(fact_consistency_gap) AS consistency, avg(plan_text_gap) AS plan_text, avg(plan_guided_gap) AS plan_fact, avg(oracle_gap) AS oracle, count(*) AS n FROM picks GROUP BY ALL",
    "same": f"SELECT model, item_id FROM ({RETOLD}) GROUP BY model, item_id HAVING bool_and(trim(text) = trim(plan_text))",
    "sp": "SELECT * FROM picks SEMI JOIN same USING (model, item_id)",
    **sql_paired("sp", "model", "item_id", "evaluator", list(VIEWS), {"reduction": "base_gap - plan_guided_gap"}, B1, 23),
    "st": "SELECT model, evaluator, count(*) AS n_strict, avg(base_gap - plan_guided_gap) AS strict_reduction FROM sp GROUP BY ALL",
    "ci": "SELECT model, " + ", ".join(f"round(max({c}) FILTER (evaluator='{v}'),6) AS reduction_{v}_{c}" for v in VIEWS for c in ("ci_lo", "ci_hi"))
          + ", " + ", ".join(f"max(excludes_zero) FILTER (evaluator='{v}') AS reduction_{v}_excludes_zero" for v in VIEWS) + " FROM pci GROUP BY model",
    "mt": "SELECT f.model, max(n) AS n_items, " + ", ".join(f"round(avg({m}),6) AS {m}" for m in ("original", "random", "consistency", "plan_text", "plan_fact", "oracle"))
          + ", max(n_strict) AS n_identical, " + ", ".join(f"round(max(strict_reduction) FILTER (f.evaluator='{v}'),6) AS reduction_{v}" for v in VIEWS)
          + " FROM f LEFT JOIN st ON st.model=f.model AND st.evaluator=f.evaluator GROUP BY f.model"})
 + "SELECT * FROM mt LEFT JOIN ci USING (model)")
def r02(spark, sf):
    picks = materialise(S.select_folds(text_counts(spark, sf), METHODS))
    strict = materialise(j10(spark, sf))
    out = R.selection_mart(picks, strict)
    ci = R.strict_intervals(picks, strict, replicates=B1, seed=23).withColumn("statistic", F.concat(F.lit("reduction_"), "evaluator"))
    out = rounded(out, [c for c in out.columns if c not in ("model", "n_items", "n_identical")])
    return out.join(wide(ci, ["model"], [f"reduction_{v}" for v in VIEWS]), ["model"], "left")


@query("r03_budget_mart", with_fx(*FXC, extra={**sql_counts(), "bc": "SELECT c.*, b.budget FROM cands c JOIN (VALUES (1),(2),(4),(8)) b(budget) ON c.cand_idx < b.budget", **sql_folds(["plan_guided"], "model, item_id, budget", "bc"),
    "f": "SELECT model, budget, evaluator, avg(base_gap-plan_guided_gap) AS r FROM picks GROUP BY ALL", "m": "SELECT model, budget, avg(r) AS macro FROM f GROUP BY ALL"})
 + "SELECT model, " + ", ".join(f"round(max(macro) FILTER (budget={b}),6) AS n{b}" for b in (1, 2, 4, 8)) + " FROM m GROUP BY model")
def r03(spark, sf):
    out = R.budget_mart(S.budget_curve(pools(spark, sf)))
    return rounded(out, ["n1", "n2", "n4", "n8"])


@query("r04_extension_summary")
def r04(spark, sf):
    c = pools(spark, sf)
    picks = S.select_folds(c)
    p, o = presence(spark, sf), observed(spark, sf)
    return R.extension_summary(S.fold_summary(picks, ["model"]), S.fold_summary(S.budget_curve(c), ["model", "budget"]), M.calibration(p, o, "SPEAK", planned("SPEAK")))


@query("r05_numbers_audit", _decomposition_sql(["asr1"]).rstrip() + ", " + ", ".join(f"{k} AS ({v})" for k, v in TAX.items() if k.endswith("SPEAK"))
       + """, hl AS (""" + SQL_A03.split("counts AS (", 1)[1].split("),\npooled AS", 1)[0] + """), hp AS (SELECT model, metric, sum(retained) AS retained, sum(total) AS total FROM hl GROUP BY model, metric)
 SELECT 'decomposition' AS section, model, metric AS name, round(1.0-CAST(retained AS DOUBLE)/nullif(CAST(total AS DOUBLE),0),6) AS value FROM pooled
 UNION ALL SELECT 'headline', model, metric, round(1.0-CAST(retained AS DOUBLE)/CAST(total AS DOUBLE),6) FROM hp
 UNION ALL SELECT 'taxonomy', model, kind, round(CAST(count(*) AS DOUBLE)/CAST(sum(count(*)) OVER (PARTITION BY model) AS DOUBLE),6) FROM kind_SPEAK GROUP BY model, kind""")
def r05(spark, sf):
    p, of = presence(spark, sf), observed_flags(spark, sf)
    o = of.drop("agree", "wer")
    pair = Pair("SPEAK", spoken("SPEAK"), planned("SPEAK"))
    up = P.item_counts(p, [pair], o).groupBy("model").agg(F.sum("total").alias("n_up"))
    tax = M.taxonomy(P.classify_losses(p, pair.down, pair.up, o), up, ["model"])
    return rounded(R.numbers_audit(M.decomposition(p, of), M.headline(p, of), tax), ["value"])


# ---- the stream ----------------------------------------------------------------------------

SQL_D06 = "SELECT channel, count(*) FILTER (error IS NULL) AS done, count(*) FILTER (error IS NOT NULL) AS failed FROM (SELECT event_type AS channel, user_id, arg_max(CASE WHEN event_id % 10 = 0 THEN 'timeout' END, (ts, event_id)) AS e, arg_max(event_id, (ts, event_id)) AS ev, CASE WHEN arg_max(event_id, (ts, event_id)) % 10 = 0 THEN 'timeout' END AS error FROM events GROUP BY event_type, user_id) GROUP BY channel"


@query("d06_stream_ledger", SQL_D06)
def d06(spark, sf):
    """Replays the event table through a file stream and returns the ledger of the last snapshot."""
    from factrail.streaming import run

    return run.replay_ledger(spark, f"{sf}/events.parquet")


@query("d06_batch_ledger", SQL_D06)
def d06b(spark, sf):
    from factrail.streaming import ledger as L
    from factrail.streaming import run

    return L.ledger(L.fold_batch(None, run.as_observations(X.table(spark, sf, "events"))))


@query("d06_window_counts", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS channel, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS n_errors, round(sum(value), 4) AS sec
 FROM events WHERE date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL""")
def d06w(spark, sf):
    """Hourly counts that the stream has closed: windows of which the watermark, an hour behind the newest event, has passed the end."""
    from factrail.streaming import run

    w = run.replay_windows(spark, f"{sf}/events.parquet")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "channel", "n", "n_errors", F.round("sec", 4).alias("sec"))


LINES = "string_split(coalesce(text, ''), chr(10))"


@query("d10_line_numbers", f"""SELECT row_number() OVER (ORDER BY doc_id, o) AS line, md5(v) AS line_md5 FROM (SELECT doc_id, unnest({LINES}) AS v, generate_subscripts({LINES}, 1) AS o FROM documents)""")
def d10l(spark, sf):
    """All documents as text files in order of their ids, read back with the number of every line over all files."""
    from factrail.sources.readers import numbered_lines

    folder = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = X.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("o", "value"))
    lines.repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "o").select("value").write.text(folder)
    return numbered_lines(spark, folder).select("line", F.md5(F.col("value").cast("binary")).alias("line_md5"))


PRIORITY = {"1": "cont", "2": "num", "3": "unit", "4": "neg", "5": "name"}


@query("p10_categories", "SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'content' WHEN '2' THEN 'number' WHEN '3' THEN 'unit' WHEN '4' THEN 'negation' WHEN '5' THEN 'proper_noun' ELSE 'other' END AS category, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def p10(spark, sf):
    o = X.table(spark, sf, "orders")
    kinds = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    named = o.withColumn("id", F.concat(F.coalesce(F.element_at(kinds, F.substring("o_orderpriority", 1, 1)), F.lit("none")), F.lit("_"), F.col("o_orderkey").cast("string")))
    return named.groupBy(T.category_of("id").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


@query("p15_config_hash", """SELECT c_custkey, substr(sha256('{"balance": ' || CAST(round(c_acctbal) AS BIGINT) || ', "name": "' || c_name || '", "segment": ' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ', "warm": ' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || '}'), 1, 16) AS config_hash FROM customer""")
def p15c(spark, sf):
    c = X.table(spark, sf, "customer")
    segment = F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))
    return c.select("c_custkey", T.config_hash({
        "warm": F.col("c_acctbal") > 0, "segment": segment, "name": F.col("c_name"), "balance": F.round("c_acctbal").cast("bigint")}, ["name", "segment"]).alias("config_hash"))


@query("t14_formatted", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'NA' ELSE printf('%.4f', l_extendedprice) END AS price FROM lineitem")
def t14(spark, sf):
    price = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    return X.table(spark, sf, "lineitem").withColumn("p", price).select("l_orderkey", "l_linenumber", T.format_value("p").alias("price"))


@query("w03_eligible_items", """WITH e AS (SELECT o_orderstatus AS model, o_orderkey AS item_id, count(*) AS a1, count(*) FILTER (l_returnflag <> 'A' OR l_linenumber > 1) AS a2, count(*) AS a3,
 bool_and(most > 2) AS known FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS most FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
 SELECT model, item_id, a1 AS n_candidates FROM e WHERE a1 = a2 AND a1 = a3 AND a1 >= 1 AND known AND item_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 20000)""")
def w03(spark, sf):
    """Lines are candidates, orders items: the second view misses some returned first lines, small lines have no extraction."""
    o = X.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("item_id"), "o_totalprice")
    lines = X.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "item_id").join(o.select("model", "item_id"), "item_id")
    views = F.array(F.lit("asr1"), F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") > 1), F.lit("asr2")), F.lit("asr3"))
    rows = lines.select("model", "item_id", "l_linenumber", "l_quantity", F.explode(F.filter(views, lambda v: v.isNotNull())).alias("view"))
    rows = rows.withColumn("key", F.concat_ws("|", F.col("item_id").cast("string"), F.col("l_linenumber").cast("string"), "view"))
    return S.eligible_items(o.where("o_totalprice > 20000"), rows, rows.where("l_quantity > 2"))
