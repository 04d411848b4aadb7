import json

import pytest
from pyspark.sql import functions as F

from factrail.operators import tasks as TK
from factrail.sources import readers, writers
from factrail.streaming import ledger as L


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_cache_scan(spark, tmp_path):
    fact = {"type": "unit", "value": "meter"}
    write(tmp_path / "c.jsonl", [
        {"key": "a|SPEAK", "text": "1", "prompt_sha256": "p", "facts_rules": [fact]}, "{broken",
        {"item_id": "b", "condition": "ECHO", "text": "2", "prompt_sha256": "p"}, {"key": "a|SPEAK", "text": "3", "prompt_sha256": "p"},
        {"key": "d|X", "text": "4", "prompt_sha256": "old"}, {"text": "no key", "prompt_sha256": "p"}])
    rows = readers.extractions(spark, str(tmp_path / "c.jsonl"), prompt_sha256="p").collect()
    assert {(r.key, r.text) for r in rows} == {("a|SPEAK", "3"), ("b|ECHO", "2")}


def test_prediction_tree_and_channels(spark, tmp_path):
    rec = {"text": "t", "audio_duration_sec": 3.5, "readback": {"asr1": "x", "asr1_sec": 1.0, "asr2_error": "e", "asr_versions": {"asr1": "w"}}}
    write(tmp_path / "run1/predictions/modelA/item7/SPEAK.json", [rec])
    p = readers.predictions(spark, str(tmp_path))
    assert [(r.run_id, r.model, r.item_id, r.condition, r.text) for r in p.collect()] == [("run1", "modelA", "item7", "SPEAK", "t")]
    long = {r.channel: (r.text, r.error, r.version) for r in readers.readbacks_long(p).collect()}
    assert long == {"asr1": ("x", None, "w"), "asr2": (None, "e", None), "asr3": (None, None, None)}


def test_shards(spark, tmp_path):
    a, b = tmp_path / "m_shard0-of-2.jsonl", tmp_path / "m_shard1-of-2.jsonl"
    write(a, [{"item_id": "1", "condition": "SPEAK", "text": "x"}])
    write(b, [{"item_id": "2", "condition": "SPEAK", "text": "y"}])
    assert readers.merge_shards(spark, [str(a), str(b)]).count() == 2
    write(b, [{"item_id": "1", "condition": "SPEAK", "text": "y"}])
    with pytest.raises(Exception, match="repeated key"):
        readers.merge_shards(spark, [str(a), str(b)]).collect()
    with pytest.raises(Exception):
        readers.merge_shards(spark, [str(a), str(tmp_path / "gone.jsonl")]).collect()


def test_one_dataset_per_manifest(spark, tmp_path):
    write(tmp_path / "i.jsonl", [{"id": "1", "category": "gsm8k", "expected_answer_text": "4"}])
    assert readers.benchmark_items(spark, str(tmp_path / "i.jsonl")).count() == 1
    write(tmp_path / "j.jsonl", [{"id": "1", "category": "gsm8k"}, {"id": "2", "category": "voicebench_bbh"}])
    with pytest.raises(Exception, match="exactly one dataset"):
        readers.benchmark_items(spark, str(tmp_path / "j.jsonl")).collect()
    with pytest.raises(Exception, match="complete set of 3"):
        TK.require_count(spark.range(2), 3).collect()


def test_write_once_and_snapshots(spark, tmp_path):
    df = spark.range(3)
    writers.write_once_json(df, str(tmp_path / "labels"))
    with pytest.raises(Exception):
        writers.write_once_json(df, str(tmp_path / "labels"))
    writers.write_snapshot(df, str(tmp_path / "t"), 1)
    writers.write_snapshot(spark.range(5), str(tmp_path / "t"), 2)
    assert writers.latest_snapshot(spark, str(tmp_path / "t")).count() == 5
    spark.range(9).write.parquet(str(tmp_path / "t" / "v=000000003"))  # a writer that was lost before it had finished
    assert writers.latest_snapshot(spark, str(tmp_path / "t")).count() == 5
    assert writers.latest_version(spark, str(tmp_path / "t"), before=2) == 1
    with pytest.raises(FileNotFoundError):
        writers.latest_snapshot(spark, str(tmp_path / "none"))


def test_item_scores_are_one_row_per_item(spark):
    facts = spark.range(25).select(F.lit("m").alias("model"), F.lit("i").alias("item_id"), F.when(F.col("id") < 20, "SPEAK").otherwise("READ").alias("condition"),
                                   F.lit("number").alias("type"), F.col("id").cast("string").alias("value"), F.lit("+").alias("polarity"))
    row, = writers.item_scores(facts.union(facts)).collect()
    assert {k: len(v) for k, v in row.scores.items()} == {"SPEAK": 20, "READ": 5}
    assert [f.value for f in row.scores["READ"]] == ["20", "21", "22", "23", "24"]


def test_coverage_scoring(spark):
    items = spark.createDataFrame([("1", "gsm8k", None, "4"), ("2", "gsm8k", None, "5")], "item_id string, dataset string, task string, gold string")
    schema = "model string, item_id string, condition string, error string, text string, asr1 string, asr2 string, asr3 string, asr1_error string, asr2_error string, asr3_error string, asr1_sec double, asr2_sec double, asr3_sec double"
    row = lambda i, t, asr1: ("m", i, "SPEAK", None, t, asr1, None, None, None, None, None, None if asr1 is None else 1.0, None, None)
    sources = [("SPEAK", "internal"), ("SPEAK", "asr1")]
    part = TK.coverage_scores(TK.graded(items, spark.createDataFrame([row("1", "it is 4", "")], schema), sources)).collect()
    got = {r.source: (r.n_present, r.n_correct, r.accuracy, r.ready) for r in part}
    assert got == {"internal": (1, 1, None, False), "asr1": (1, 0, None, False)}
    full = TK.coverage_scores(TK.graded(items, spark.createDataFrame([row("1", "it is 4", ""), row("2", "6", "5")], schema), sources)).collect()
    assert {r.source: (r.accuracy, r.n_extracted) for r in full} == {"internal": (0.5, 2), "asr1": (0.5, 1)}


def test_ledger_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, item_id long, channel string, sec double, error string"
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 1, 0, m)
    sink = L.LedgerSink(spark, str(tmp_path / "state"))
    sink(spark.createDataFrame([(1, at(1), 7, "asr1", 1.0, "bad"), (2, at(1), 8, "asr1", 1.0, None)], schema), 0)
    second = spark.createDataFrame([(3, at(2), 7, "asr1", 2.0, None)], schema)
    sink(second, 1)
    sink(second, 1)  # a replay after a failure
    sink(second.limit(0), 5)  # batches in between wrote nothing
    rows = L.ledger(sink.state()).collect()
    assert [(r.channel, r.done, r.failed) for r in rows] == [("asr1", 2, 0)]
