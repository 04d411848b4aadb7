"""Filters captures of web pages by dated lists: DataFrame functions only.

A list is a history of entries (key, listed_on, action): block, allow or remove. Per key, an entry holds from its date to
the date of the next one; `remove` ends the one before and leaves a gap. Keys are domains, which hold for all their
subdomains, or `host/first-path-segment/` prefixes. A capture is judged by the entries that were active when it was fetched, not
by the list of today; the longest matching key decides.

The as-of join is an equi-join: intervals are dealt to the periods they touch, captures to their own, and the join is on
key and period, with the exact dates as a filter. A host that holds a third of all captures is so spread over periods, and
adaptive execution may split what is left; nothing is broadcast by hint and no list is scanned per capture.

Cases: a null or unreadable url, or a null date, matches nothing (`none`); two entries of a key on one day count as the
stricter one (block, allow, remove); repeated captures are judged each on their own; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 28
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/"
_STRICT = ("remove", "allow", "block")


def host_of(url):
    """Lower-case host without a trailing dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), "\\.$", "")
    return F.when(host != "", host)


def keys_of(url):
    """All keys that can match: the host, its parent domains of at least two labels, and the host with its first path segment."""
    host = host_of(url)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    prefix = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment, F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, prefix)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (null: still valid) of a list's block and allow entries."""
    rank = F.array_position(F.array(*[F.lit(a) for a in _STRICT]), F.col("action"))
    daily = entries.where("key is not null and listed_on is not null").groupBy("key", F.col("listed_on").alias("valid_from")).agg(F.max_by("action", rank).alias("action"))
    upto = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    return daily.withColumn("valid_to", upto).where("action <> 'remove'").select("key", "action", "valid_from", "valid_to")


def _period(day):
    return F.floor(F.unix_date(day) / PERIOD_DAYS)


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, verdict, matched_key, listed_on of every row of captures (page_id, url, fetched_on)."""
    rows = captures.select("page_id", "url", "fetched_on").withColumn("row_", F.monotonically_increasing_id())
    rows = rows.select("row_", "page_id", host_of(F.col("url")).alias("host"), "fetched_on", F.explode_outer(keys_of(F.col("url"))).alias("key"))
    rows = rows.withColumn("period", _period(F.col("fetched_on")))
    span = captures.agg(F.min("fetched_on").alias("a"), F.max("fetched_on").alias("b")).first()
    valid = intervals(entries)
    if span.a is None:
        valid = valid.where(F.lit(False)).withColumn("period", F.lit(0).cast("bigint"))
    else:
        first, last = F.lit(span.a), F.lit(span.b)
        valid = valid.where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
        valid = valid.withColumn("period", F.explode(F.sequence(_period(F.greatest("valid_from", first)), _period(F.least(F.coalesce("valid_to", last), last)))))
    c, v = rows.alias("c"), valid.alias("v")
    active = (F.col("c.key") == F.col("v.key")) & (F.col("c.period") == F.col("v.period")) & (F.col("fetched_on") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    hit = F.when(F.col("v.key").isNotNull(), F.struct(F.length("v.key").alias("size"), F.col("v.key").alias("key"), "action", "valid_from"))
    best = c.join(v, active, "left").groupBy("row_", "page_id", "host", "fetched_on").agg(F.max(hit).alias("hit"))
    return best.select("page_id", "host", "fetched_on", F.coalesce("hit.action", F.lit("none")).alias("verdict"), F.col("hit.key").alias("matched_key"), F.col("hit.valid_from").alias("listed_on"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch date spread over a year by page_id: the tables carry none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts and parent domains of pages: digits of a digest of the key give dates and actions."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct().withColumn("d", F.md5("key"))
    part = lambda at, size: F.conv(F.substring("d", at, size), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first = part(1, 2)
    listed = keys.where(part(9, 1) < 10)
    one = listed.select("key", day(first).alias("listed_on"), F.when(part(10, 1) < 11, F.lit("block")).otherwise(F.lit("allow")).alias("action"))
    two = listed.where(part(11, 1) < 8).select("key", day(first + 1 + part(3, 2)).alias("listed_on"), F.lit("remove").alias("action"))
    three = listed.where(part(11, 1) < 4).select("key", day(first + 1 + part(3, 2) + part(5, 2)).alias("listed_on"), F.when(part(12, 1) < 8, F.lit("block")).otherwise(F.lit("allow")).alias("action"))
    return one.unionByName(two).unionByName(three)
