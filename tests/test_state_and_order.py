"""Bucketed tables, closed windows of a stream, line numbers over splits, exact quantiles, short passages."""

import os
import random
from datetime import datetime, timedelta
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from factrail.operators.merging import upsert
from factrail.operators.ranking import quantile
from factrail.plans.metrics import texts_with_gold
from factrail.sources import buckets as T
from factrail.sources.readers import numbered_lines
from factrail.streaming import run


def put(old, new):
    return new if old is None else upsert(old, new, ["key"])


def folders(root):
    return {f"{v}/{b}" for v in os.listdir(f"{root}/data") for b in os.listdir(f"{root}/data/{v}") if b.startswith("bucket=")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda *xs: spark.createDataFrame(list(xs), "key string, n int")
    T.upsert_table(rows(*[(f"k{i}", i) for i in range(400)], (None, -1)), root, 1, ["key"], put, buckets=16)
    first = folders(root)
    assert len(first) == 16
    T.upsert_table(rows(("k7", 70), ("new", 5)), root, 2, ["key"], put)
    assert 1 <= len(folders(root) - first) <= 2
    want = {f"k{i}": i for i in range(400)} | {None: -1, "k7": 70, "new": 5}
    assert {r.key: r.n for r in T.read_table(spark, root).collect()} == want
    assert T.read_table(spark, root, 1).where("key = 'k7'").first().n == 7  # the old version stays readable
    T.upsert_table(rows(("k7", 70), ("new", 5)), root, 2, ["key"], put)  # written again after a failure
    assert {r.key: r.n for r in T.read_table(spark, root).collect()} == want
    T.upsert_table(rows(), root, 3, ["key"], put)
    T.upsert_table(rows(("k7", 0)), root, 4, ["key"], lambda old, new: old.join(new, "key", "left_anti"))
    assert {r.key for r in T.read_table(spark, root).collect()} == set(want) - {"k7"}
    before = folders(root)
    assert T.expire(spark, root, keep=1) == len(before - folders(root)) > 0
    assert {r.key for r in T.read_table(spark, root).collect()} == set(want) - {"k7"} and len(folders(root)) == 16
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, str(tmp_path / "none"))


def test_windows_survive_a_restart_with_late_and_repeated_events(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    start = datetime(2024, 1, 1)
    event = lambda i, m, kind="view": (i, start + timedelta(minutes=m), 1, kind, 1.0, None)
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")

    def run_over(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        return {(int((r.start - start).total_seconds() // 3600), r.channel): (r.n, r.n_errors) for r in run.append_windows(source, root).collect()}

    assert run_over(event(1, 10), event(2, 50), event(2, 50), event(10, 30), event(3, 130), event(4, 175)) == {(0, "view"): (3, 1)}
    # a repeat of an open window's event, one behind the watermark, one late within it, and what closes the hours 1 to 3
    second = run_over(event(3, 130), event(5, 20), event(6, 125, "click"), event(7, 330))
    assert second == {(0, "view"): (3, 1), (2, "view"): (2, 0), (2, "click"): (1, 0)}


def test_numbered_lines_over_splits(spark, tmp_path):
    r = random.Random(3)
    lines = {f"{k}.txt": ["é" * r.randrange(0, 60) + str(i) for i in range(n)] for k, n in (("a", 700), ("b", 1), ("c", 2000))}
    for name, xs in lines.items():
        (tmp_path / name).write_text("\n".join(xs) + ("\n" if name != "b.txt" else ""), encoding="utf-8")
    (tmp_path / "d.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert [r.value for r in got.orderBy("line").collect()] == [x for name in sorted(lines) for x in lines[name]]
        assert [r.line for r in got.orderBy("line").select("line").collect()] == list(range(1, 2702))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quantile(spark):
    r = random.Random(5)
    data = [(g, r.choice([0.5, 1.0, 2.5, 7.0, None]), r.randrange(0, 4)) for g in "ab" for _ in range(30)] + [("one", 3.0, 1), ("none", None, 2)]
    cells = spark.createDataFrame(data, "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    flat = {g: [v for h, v, n in data if h == g and v is not None for _ in range(n)] for g in ("a", "b", "one")}
    for share in (0.0, 0.1, 0.5, 0.95, 1.0):
        got = {x.g: x.q for x in quantile(cells, ["g"], "v", "n", share, "q").collect()}
        assert got == pytest.approx({g: float(np.quantile(x, share)) for g, x in flat.items()})
    every = cells.groupBy("v").agg(F.sum("n").alias("n"))
    assert quantile(every, [], "v", "n", 0.5, "q").first().q == median(x for xs in flat.values() for x in xs)
    assert quantile(every.limit(0), [], "v", "n", 0.5, "q").collect() == []


def test_short_and_long_passages(spark):
    golds = ["", "b", "CAT", "a cat", "red house on", "quick brown fox jumps over the lazy", "not there at all", "😀x", "the the"]
    texts = ["A quick brown fox jumps over the lazy dog", "concatenate 😀x", "", None, "the thefts", "a  cat; a cat", "a red house on hills " * 50]
    g = spark.createDataFrame(list(enumerate(golds)), "item_id int, text string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {i: 0 if x is None else sum(p.lower() in x.lower() for p in golds) for i, x in enumerate(texts)}
    found = texts_with_gold(t, g)
    assert {r.doc_id: r.n_golds for r in found.collect()} == want and all(r.found == (r.n_golds > 0) for r in found.collect())
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.n_golds for r in texts_with_gold(t, g.where("item_id = 0")).collect()} == {0, 1}
    assert texts_with_gold(t, g.limit(0)).where("found").count() == 0
