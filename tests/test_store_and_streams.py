"""Table store idempotency and atomic batches; streaming dedup; sweep."""

import datetime as dt

from pyspark.sql import functions as F

from assaykit.plans import pipeline as P
from assaykit.plans.store import TableStore
from assaykit.session import scratch_dir
from assaykit.streaming.jobs import dedup_exact

B = '{"patient_id": "P%d", "assessment_type": "t", "score_x": %d}'


def test_store_is_idempotent_and_first_write_wins(spark, payloads):
    store = TableStore(spark, scratch_dir(spark, "t-store"))
    g = P.run_gate(payloads(("provider_b", B % (1, 5)), ("provider_b", B % (2, 500)), ("provider_b", "bad")))
    store.write_gate_batch(g, 0)
    store.write_gate_batch(g, 0)          # retried batch
    store.write_gate_batch(g, 1)          # same content again
    assert store.read("assessments").count() == 1
    assert store.read("outbox").count() == 1
    assert store.read("normalization_audit_log").count() == 1
    assert store.read("failed_records").count() == 2
    assert store.read("schema_violations").count() == 2   # one pre, one post


def test_uncommitted_batch_is_invisible(spark, payloads):
    store = TableStore(spark, scratch_dir(spark, "t-store2"))
    g = P.run_gate(payloads(("provider_b", B % (1, 5))))
    a = P.assessment_rows(g).select("id", "created_at")
    store._write("assessments", a, 7)     # rows written, no commit marker
    assert store.read("assessments") is None


def test_exact_dedup_window(spark):
    root = scratch_dir(spark, "t-dedup")
    base = dt.datetime(2024, 1, 1)
    mins = [0, 5, 9, 11, 15, 30]
    df = spark.createDataFrame([(1, base + dt.timedelta(minutes=m)) for m in mins] + [(2, base)],
                               "id int, ts timestamp")
    df.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
    q = (dedup_exact(stream, "id", "ts").writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out").filter("id = 1").orderBy("ts").collect()
    assert [int((r["ts"] - base).total_seconds() // 60) for r in out] == [0, 11, 30]
