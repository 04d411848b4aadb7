"""The queries of this subpackage and their check SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from factrail.llm import alignment, exact_dedup, filter_audit, fingerprints, jaccard_join, langid, mixing, packing, pii, simhash, token_output, toxicity, url_filter
from factrail.llm.common import ASCII_LOWER, ASCII_UPPER, documents, ship

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_LOWER = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


@query("op2_token_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.scratch_path(spark)
    token_output.write_tokens(documents(spark, sf_dir), path)
    return token_output.token_digests(spark, path)


@query("op3_langid")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_KEYS = r"""
p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_on,
             nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/', 1) AS segment FROM pages),
k AS (SELECT page_id, host, fetched_on, unnest(list_distinct(list_concat(
             list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
             CASE WHEN segment <> '' THEN [host || '/' || segment || '/'] ELSE [] END))) AS key FROM p WHERE host IS NOT NULL)"""


def _digit(at: int, size: int) -> str:
    return f"('0x' || substr(d, {at}, {size}))::INT"


@query("op5_url_filter", f"""
WITH {_KEYS},
l AS (SELECT key, md5(key) AS d FROM (SELECT DISTINCT key FROM k)),
s AS (SELECT * FROM l WHERE {_digit(9, 1)} < 10),
e AS (SELECT key, DATE '2024-01-01' + {_digit(1, 2)} AS valid_from, CASE WHEN {_digit(10, 1)} < 11 THEN 'block' ELSE 'allow' END AS action FROM s
      UNION ALL SELECT key, DATE '2024-01-01' + ({_digit(1, 2)} + 1 + {_digit(3, 2)}), 'remove' FROM s WHERE {_digit(11, 1)} < 8
      UNION ALL SELECT key, DATE '2024-01-01' + ({_digit(1, 2)} + 1 + {_digit(3, 2)} + {_digit(5, 2)}), CASE WHEN {_digit(12, 1)} < 8 THEN 'block' ELSE 'allow' END
      FROM s WHERE {_digit(11, 1)} < 4),
f AS (SELECT key, valid_from, arg_max(action, CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to FROM f),
h AS (SELECT k.page_id, v.key, v.action, v.valid_from,
             row_number() OVER (PARTITION BY k.page_id ORDER BY length(v.key) DESC, v.key DESC, v.action DESC, v.valid_from DESC) AS r
      FROM k JOIN v ON k.key = v.key AND k.fetched_on >= v.valid_from AND (v.valid_to IS NULL OR k.fetched_on < v.valid_to) WHERE v.action <> 'remove')
SELECT p.page_id, p.host, p.fetched_on, coalesce(h.action, 'none') AS verdict, h.key AS matched_key, h.valid_from AS listed_on
FROM p LEFT JOIN h ON p.page_id = h.page_id AND h.r = 1""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judged(url_filter.derived_captures(pages), url_filter.derived_entries(pages))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query("op7_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


@query("op10_mixing", f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('{mixing.SEED}:' || doc_id) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS full_at, sum(source_size) OVER () AS total,
             sum(cap) OVER (ORDER BY cap / weight) AS held, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight) AS free FROM w),
l AS (SELECT min(level) AS level FROM (
        SELECT any_value(total)::DOUBLE / sum(weight) AS level, 0::DOUBLE AS below, min(full_at) AS above FROM o
        UNION ALL SELECT (total - held)::DOUBLE / free, full_at, (SELECT min(x.full_at) FROM o x WHERE x.full_at > o.full_at) FROM o WHERE free > 0.5)
      WHERE level >= below AND level <= above),
t AS (SELECT source, source_size, least(coalesce(level, 0) * weight, cap::DOUBLE) AS target FROM w CROSS JOIN l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
z AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, round(q.target)::BIGINT - q.whole * q.source_size AS quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(least(size, quota - before), 0))::BIGINT AS taken FROM z""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(documents(spark, sf_dir))


@query("op11_simhash_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(documents(spark, sf_dir))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(documents(spark, sf_dir))


def _audit_sql() -> str:
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    orders = " CROSS JOIN ".join(f"{letters} l{i}(f{i})" for i in range(5))
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(doc_id, 9223372036854775807) AS id FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '{word}') AS words, id > min(id) OVER (PARTITION BY t) AS again FROM d),
g AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN again THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
o AS (SELECT f0 || f1 || f2 || f3 || f4 AS filter_order FROM {orders} WHERE len(list_distinct([f0, f1, f2, f3, f4])) = 5),
x AS (SELECT c.*, filter_order, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda f: strpos(filter_order, f))), 9) AS out FROM c CROSS JOIN o),
s AS (SELECT part, filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS BIGINT), 1) AS f, fails, out, n, n_good, n_toxic FROM x CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (out > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (out = step), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (out < step AND contains(fails, f)), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(n_good) FILTER (out = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (out = step), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""


@query("op13_filter_audit", _audit_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
