"""Which items take part in selection; hashes of settings."""

import hashlib
import json

from pyspark.sql import functions as F

from factrail.functions import text as T
from factrail.operators.selection import eligible_items


def test_config_hash_is_that_of_sorted_json(spark):
    names = ["plain", "", 'q"\\/', "tab\tnl\n\r\b\f\x01\x7f", "é中😀", None]
    rows = [(s, i - 2, None if i == 3 else i % 2 == 0) for i, s in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, n int, flag boolean")
    got = [r.h for r in df.select(T.config_hash({"z": F.col("name"), "a": F.col("n"), "é": F.col("flag")}, ["z"]).alias("h")).collect()]
    assert got == [hashlib.sha256(json.dumps({"z": s, "a": n, "é": b}, sort_keys=True).encode()).hexdigest()[:16] for s, n, b in rows]


def test_eligible_items(spark):
    views = ("asr1", "asr2", "asr3")
    def item(i, sizes, drop=()):
        return [("m", i, v, f"{i}{v}{k}") for v, n in zip(views, sizes) for k in range(n) if (v, k) not in drop]
    expected = item("whole", (2, 2, 2)) + item("short", (2, 2, 1)) + item("noplan", (1, 1, 1)) + item("missing", (2, 2, 2)) + item("one", (1, 1, 1)) + item("noview", (1, 1, 0))
    expected += [("m", "nullkey", v, None) for v in views]
    known = [(k,) for _, i, v, k in expected if not (i == "missing" and v == "asr3" and k.endswith("1"))] * 2
    plan = [("m", i, "number", "4") for i in ("whole", "short", "missing", "one", "noview", "nullkey", "none") for _ in range(2)]
    got = eligible_items(
        spark.createDataFrame(plan, "model string, item_id string, type string, value string"),
        spark.createDataFrame(expected, "model string, item_id string, view string, key string"), spark.createDataFrame(known, "key string"))
    assert sorted((r.item_id, r.n_candidates) for r in got.collect()) == [("one", 1), ("whole", 2)]
