"""Outbox transitions (9/10 boundary), delivery outcomes, triage, disposition, batch status."""

import datetime as dt

from pyspark.sql import functions as F

from assaykit.operators import aggregates as A, outbox as O, timeseries as TS
from assaykit.plans import pipeline as P
from assaykit.sources.payloads import explode_batch

def _as_of():
    return F.lit(dt.datetime(2024, 1, 2))


def _outbox(spark, rows):
    return spark.createDataFrame(rows, "id string, assessment_id string, payload string, status string, "
                                       "retries int, created_at timestamp, flushed_at timestamp")


def test_retry_boundary(spark):
    t = dt.datetime(2024, 1, 1)
    ob = _outbox(spark, [("1", "a", "{}", "pending", 8, t, None), ("2", "b", "{}", "pending", 9, t, None),
                         ("3", "c", "{}", "flushed", 3, t, t), ("4", "d", "{}", "pending", 0, t, None)])
    res = spark.createDataFrame([("a", "all_failed"), ("b", "partial_failure"), ("c", "all_failed"),
                                 ("d", "all_succeeded")], "assessment_id string, outcome string")
    out = {r["assessment_id"]: (r["status"], r["retries"], r["flushed_at"] is not None)
           for r in O.apply_sweep_outcome(ob, res, _as_of()).collect()}
    assert out["a"] == ("pending", 9, False)
    assert out["b"] == ("failed", 10, False)
    assert out["c"] == ("flushed", 3, True)     # never re-picked
    assert out["d"] == ("flushed", 0, True)


def test_delivery_outcomes(spark):
    fan = spark.createDataFrame([("a", "s1", True, None), ("a", "s2", True, None), ("b", "s1", False, "x"),
                                 ("c", "s1", True, None), ("c", "s2", False, "boom")],
                                "assessment_id string, sink_name string, ok boolean, error string")
    out = {r["assessment_id"]: (r["outcome"], r["last_error"]) for r in O.delivery_results(fan).collect()}
    assert out == {"a": ("all_succeeded", None), "b": ("all_failed", "x"), "c": ("partial_failure", "boom")}


def test_triage(spark):
    uid = "4f1c2a9e-1b2c-4d3e-8f90-123456789abc"
    env = ('{"assessment": {"id": "%s", "patientId": "x", "assessmentDate": "2024-01-01T00:00:00Z", '
           '"assessmentType": "gait", "scores": [], "metadata": {"sourceProvider": "provider_b", "sourceFormat": '
           '"flat_kv", "ingestedAt": "2024-01-01T00:00:00Z", "version": "1.0"}}, "audit": {"input_hash": "h", '
           '"input_size_bytes": 3, "transformations": [], "duration_us": 7, "provider": "provider_b", '
           '"source_format": "flat_kv", "score_count": 0}}') % uid
    bare = '{"assessment": {"id": "%s", "patientId": "x"}, "audit": {}}' % uid
    typed_wrong = env.replace('"score_count": 0', '"score_count": "0"')
    legacy = '{"id": "4f1c2a9e-1b2c-4d3e-8f90-123456789abc", "patientId": "x"}'
    df = spark.createDataFrame([("e", env), ("l", legacy), ("p", "not json"), ("q", '{"assessment": 1}'), ("b", bare),
                                ("w", typed_wrong), ("t", env + " x"), ("a", "[1]"), ("n", "7"), ("0", None)],
                               "k string, body string")
    out = {r["k"]: r["kind"] for r in O.triage(df).collect()}
    assert out == {"e": "envelope", "l": "legacy", "p": "poison", "q": "legacy", "b": "legacy", "w": "legacy",
                   "t": "poison", "a": "legacy", "n": "legacy", "0": "poison"}


def test_disposition(spark):
    df = spark.createDataFrame([
        ("poison", True, True, 1), ("envelope", False, True, 1), ("envelope", False, True, 4),
        ("envelope", False, True, 5), ("legacy", True, False, 1), ("envelope", True, False, 1)],
        "kind string, db_ok boolean, sink_ok boolean, attempt int")
    d = O.disposition(F.col("kind"), F.col("db_ok"), F.col("sink_ok"), F.col("attempt"))
    out = [(r[0], r[1]) for r in df.select(d["action"], d["retry_after_secs"]).collect()]
    assert out == [("quarantined", None), ("retry", 5), ("retry", 5), ("quarantined", None),
                   ("retry", 10), ("accepted", None)]


def test_batch_207(spark):
    body = ('[{"provider": "provider_b", "data": {"patient_id": "QX-80", "assessment_type": "posture", '
            '"score_balance": 33}}, {"provider": "nobody_knows", "data": {}}]')
    sub = spark.createDataFrame([("s1", body, dt.datetime(2024, 1, 1))], "submission_id string, body string, "
                                                                         "received_at timestamp")
    items = explode_batch(sub)
    rows = items.orderBy("item_index").collect()
    assert [r["item_index"] for r in rows] == [0, 1]
    assert rows[0]["raw"] == '{"assessment_type":"posture","patient_id":"QX-80","score_balance":33}'
    g = P.run_gate(items.select("payload_id", "provider", "raw", "received_at")).collect()
    stages = sorted(r["stage"] for r in g)
    assert stages == ["ok", "provider"]


def test_batch_status(spark):
    """No items: 200; a body that is not an array: 400; a null provider is unknown."""
    t = dt.datetime(2024, 1, 1)
    good = '{"provider": "provider_b", "data": {"patient_id": "QX-81", "assessment_type": "grip", "score_hold": 12}}'
    sub = spark.createDataFrame([("none", "[]", t), ("text", "nonsense", t), ("null", '[{"data": {}}]', t),
                                 ("both", f"[{good}, {{}}]", t), ("good", f"[{good}]", t)],
                                "submission_id string, body string, received_at timestamp")
    g = P.run_gate(explode_batch(sub), carry=("submission_id", "item_index", "batch_ok"))
    kinds = {r["submission_id"]: r["error_kind"] for r in g.filter("item_index = 0").collect()}
    assert kinds["null"] == "unknown_provider"
    out = {r["submission_id"]: (r["n_items"], r["n_failed"], r["status"]) for r in A.batch_summary(g).collect()}
    assert out == {"none": (0, 0, 200), "text": (0, 0, 400), "null": (1, 1, 400), "both": (2, 1, 207),
                   "good": (1, 0, 200)}


def test_alerts(spark):
    """Rules without samples stay visible; ``for`` is the distance of the first and last firing samples."""
    t = [dt.datetime(2024, 1, 1, 0, 5 * i) for i in range(6)]
    samples = spark.createDataFrame([("m", t[0], 9.0), ("m", t[1], 9.0), ("m", t[2], 0.0), ("m", t[4], 9.0)],
                                    "metric string, window_start timestamp_ntz, value double")
    rules = TS.rules_frame(spark, [("r", "m", ">", 1.0, 300, "warning"), ("unfed", "x", ">", 1.0, 300, "warning")])
    ev = TS.alert_threshold(samples, rules)
    assert [(r["window_start"], r["firing"]) for r in ev.filter("rule = 'unfed'").collect()] == [(None, None)]
    out = [(r["rule"], r["island_start"], r["duration_seconds"]) for r in TS.alert_sustained(ev, 300).collect()]
    assert out == [("r", t[0], 300)]
