"""Queries run the gate once and read what it wrote; groups of the duplicate window; the second JSON parse."""

import json
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from assaykit.functions import jsonx
from assaykit.operators import leaks
from assaykit.plans import catalog
from assaykit.streaming.jobs import _exact_fold


def test_failures_and_messages_are_read_from_what_the_gate_wrote(spark, tmp_path):
    spark.range(1, 200).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-05 10:00:00' AS ts", "id % 7 AS user_id", "'click' AS event_type",
        "CAST(id AS double) AS value", """concat('{"k": ', id % 90, '}') AS props""").write.parquet(f"{tmp_path}/events.parquet")
    env, legacy, _ = catalog._messages(spark, str(tmp_path))
    for rows in (catalog._replay_inputs(spark, str(tmp_path)), env, legacy):
        files = rows.inputFiles()
        assert files and not any("events.parquet" in f for f in files) and rows.count()


def test_one_call_of_the_duplicate_window_takes_many_keys():
    held = {}
    state = SimpleNamespace(exists=False, get=None, update=lambda v: held.update(v=v[0]))
    rows = pd.DataFrame({"id": [1, 2, 1, 1], "_ts_us": [5, 0, 0, 12], "_key": ["=1", "=2", "=1", "=1"], "_group": [7] * 4})
    out = next(_exact_fold(10)((7,), iter([rows[:2], rows[2:]]), state))
    assert out["id"].tolist() == [2, 1, 1] and list(out.columns) == ["id"]
    assert json.loads(held["v"]) == {"=1": 12, "=2": 0}
    later = SimpleNamespace(exists=True, get=(held["v"],), update=lambda v: None)
    assert next(_exact_fold(10)((7,), iter([rows[2:]]), later)).empty


def test_a_text_without_a_closing_bracket_is_parsed_once(spark):
    texts = ['{"a":1}', '{"a":1} x', "1]", "1,2", "[1]", "[1],2", "", '{"a":[1]}', '{"a":1}]', "1],[2", None, "[1]]"]
    one, two = jsonx.strict_wrappers_sql("raw")
    df = spark.createDataFrame([(t,) for t in texts], "raw string").select(
        F.to_json(jsonx.strict_parse("raw")).alias("v"), F.to_json(F.expr(two)).alias("two"), "raw")
    got = df.collect()
    assert [r.v for r in got] == ['{"a":1}', None, None, None, "[1]", None, None, '{"a":[1]}', None, None, None, None]
    assert {r.two for r in got if "]" not in (r.raw or "")} == {"[null,1]"}


def test_identifiers_of_a_scan_are_read_once_for_all_tables(spark, monkeypatch):
    calls, real = [], leaks._shards
    monkeypatch.setattr(leaks, "_shards", lambda *a: calls.append(1) or real(*a))
    ids = spark.createDataFrame([("U1",)], "i string")
    t = spark.createDataFrame([("see U1",), ("U12",)], "c string")
    found = {r.table_name: r.n_leaks for r in leaks.scan_tables({"x": t, "y": t}, ids, "i").collect()}
    assert found == {"x": 1, "y": 1} and len(calls) == 1
