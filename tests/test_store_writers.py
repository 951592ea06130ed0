"""Writers that share a store, batches without rows, and one delivery per sweep."""

import datetime as dt
import json

from pyspark.sql import functions as F

from assaykit.operators import joins as J
from assaykit.plans import pipeline as P
from assaykit.plans.store import TableStore
from assaykit.session import scratch_dir
from assaykit.streaming.jobs import deliver_console, run_sweep

B = '{"patient_id": "P%d", "assessment_type": "t", "score_x": %d}'


def test_writers_with_the_same_batch_id_keep_their_rows(spark, payloads):
    store = TableStore(spark, scratch_dir(spark, "t-writers"))
    both = P.run_gate(payloads(("provider_b", B % (1, 5)), ("provider_b", B % (2, 6)))).select("*").persist()
    first, second = (both.filter(F.col("payload_id") == f"p{i}") for i in (0, 1))
    store.as_writer("one").write_gate_batch(first, 0)
    store.as_writer("two").write_gate_batch(second, 0)
    store.as_writer("three").write_gate_batch(both, 0)           # a restart on a new checkpoint
    assert store.read("assessments").count() == 2
    assert {r["status"] for r in store.outbox_current().collect()} == {"pending"}
    both.unpersist()


def test_a_batch_computes_its_rows_once(spark, payloads, monkeypatch):
    store = TableStore(spark, scratch_dir(spark, "t-computed-once"))
    read, write = {}, TableStore._write
    monkeypatch.setattr(TableStore, "_write", lambda self, table, df, n: read.setdefault(table, df.inputFiles()) and None
                        or write(self, table, df, n))
    store.write_gate_batch(P.run_gate(payloads(("provider_b", B % (1, 5)), ("provider_b", "bad"))), 0)
    assert len(read) == 5 and all(files and all("/_work/" in f for f in files) for files in read.values())
    left = spark.read.schema("payload_id string").option("recursiveFileLookup", "true").parquet(f"{store.root}/_work")
    assert left.count() == 0


def test_an_envelope_is_made_once_after_its_row_is_dealt(spark, payloads, monkeypatch):
    made, envelope = spark.sparkContext.accumulator(0), P.envelope_json

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    store, dealt, write = TableStore(spark, scratch_dir(spark, "t-envelopes")), {}, TableStore._write
    monkeypatch.setattr(P, "envelope_json", lambda a: counted(envelope(a)))
    monkeypatch.setattr(TableStore, "_write", lambda self, table, df, n: dealt.update(
        {table: df._jdf.queryExecution().logical().toString()}) or write(self, table, df, n))
    store.write_gate_batch(P.run_gate(payloads(*[("provider_b", B % (i, i)) for i in range(40)])), 0)
    assert made.value == store.read("outbox").count() == 40
    assert {t for t, plan in dealt.items() if "RepartitionByExpression" in plan} == {"normalization_audit_log", "outbox"}
    ids = [{r[0] for r in store.read(t).select(c).collect()} for t, c in (
        ("assessments", "id"), ("normalization_audit_log", "assessment_id"), ("outbox", "assessment_id"))]
    assert len(ids[0]) == 40 and ids[0] == ids[1] == ids[2]


def test_rows_with_one_id_give_one_assessment_audit_and_outbox_row_of_the_same_message(spark, payloads):
    rows = P.assessment_rows(P.run_gate(payloads(*[("provider_b", B % (i, i)) for i in range(20)])))
    store = TableStore(spark, scratch_dir(spark, "t-one-id"))
    store.write_envelope_batch(rows.withColumn("id", F.lit("one")), 0)
    stored, audit, box = (store.read(t).first() for t in ("assessments", "normalization_audit_log", "outbox"))
    told = json.loads(box.payload)
    assert told["assessment"]["scores"][0]["value"] == stored.scores[0]["value"]
    assert told["audit"]["input_hash"] == audit.input_hash and store.read("outbox").count() == 1


def test_batches_without_rows_of_a_kind(spark, payloads):
    store = TableStore(spark, scratch_dir(spark, "t-empty"))
    store.write_gate_batch(P.run_gate(payloads(("provider_b", "bad"))), 0)               # all failed
    assert store.read("assessments").count() == 0 and store.read("failed_records").count() == 1
    store.write_gate_batch(P.run_gate(payloads(("provider_b", B % (1, 5)))), 1)          # all clean
    store.write_gate_batch(P.run_gate(payloads(("provider_b", "also bad"))), 2)
    assert store.read("assessments").count() == 1 and store.read("failed_records").count() == 2


def _swept(spark, payloads, sinks, deliver):
    store = TableStore(spark, scratch_dir(spark, "t-once"))
    store.write_gate_batch(P.run_gate(payloads(*[("provider_b", B % (i, 5)) for i in range(3)])), 1)
    states = run_sweep(store, sinks, deliver, F.lit(dt.datetime(2024, 10, 16)), batch_id=1)
    assert store.read("assessments").count() == 3                # the sweep's batch 1 is its own
    return states, store


def test_sweep_sends_once(spark, payloads):
    sent = spark.sparkContext.accumulator(0)

    def deliver(fan, _):
        def post(frames):
            for f in frames:
                sent.add(len(f))
                yield f.assign(ok=True, error=None)[["assessment_id", "sink_name", "ok", "error"]]
        return fan.select("assessment_id", "sink_name").mapInPandas(
            post, "assessment_id string, sink_name string, ok boolean, error string")

    sinks = J.active_sinks(J.sinks_frame(spark, [{"name": "h", "sink_type": "http_json"}]))
    states, store = _swept(spark, payloads, sinks, deliver)
    assert [r["status"] for r in states.collect()] == ["flushed"] * 3
    assert {r["status"] for r in store.outbox_current().collect()} == {"flushed"} and sent.value == 3


def test_rows_without_any_sink_are_flushed(spark, payloads):
    none = J.active_sinks(J.sinks_frame(spark, [{"name": "x", "sink_type": "carrier_pigeon"}]))
    _, store = _swept(spark, payloads, none, lambda fan, _: fan.select(
        "assessment_id", "sink_name", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
    assert {r["status"] for r in store.outbox_current().collect()} == {"flushed"}


def test_console_prints_every_row(spark, capsys):
    deliver_console(spark.range(45).select(F.to_json(F.struct("id")).alias("assessment_json")))
    out = capsys.readouterr().out
    assert out.count('"id"') == 45 and json.loads(out[:out.index("}") + 1]) == {"id": 0}
