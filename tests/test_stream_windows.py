"""Windows and alert timers over streams against their batch forms."""

import datetime as dt
import random

from pyspark.sql import functions as F

from assaykit.operators import timeseries as TS
from assaykit.plans.store import TableStore
from assaykit.session import scratch_dir
from assaykit.streaming.windows import firing_islands, late_rows, start_window_counts, window_counts

T0 = dt.datetime(2024, 3, 1, 12, 0)


def test_window_counts_over_restarts_and_late_rows(spark):
    root = scratch_dir(spark, "t-windows")
    store = TableStore(spark, f"{root}/store")
    turns = [[("a", 0, True), ("b", 1, False), ("a", 4, False)], [("a", 3, False), ("a", 16, True)],
             [("b", 2, True), ("a", 17, False), ("a", 31, False)], [("a", 1, True), ("b", 32, True)]]
    late = 0
    for rows in turns:
        spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), e) for k, m, e in rows], "k string, ts timestamp_ntz, e boolean") \
            .coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("k string, ts timestamp_ntz, e boolean").parquet(f"{root}/in")
        q = start_window_counts(stream, store, f"{root}/ckpt", "ts", F.col("e"), ["k"], late_after="10 minutes")
        q.awaitTermination()
        late += late_rows(q)
    got = {(r.k, int((r.window_start - T0).total_seconds() // 60)): (r.total, r.errors)
           for r in window_counts(store, ["k"]).collect()}
    # the window of minutes 0 to 5 ended when the watermark passed it: minute 2 of turn 3 and minute 1 of turn 4 were late
    assert got == {("a", 0): (3, 1), ("b", 0): (1, 0), ("a", 15): (2, 1), ("a", 30): (1, 0), ("b", 30): (1, 1)}
    assert late == 2


def test_firing_islands_equal_the_batch_form(spark):
    root, rnd = scratch_dir(spark, "t-islands"), random.Random(3)
    rows = [(rule, T0 + dt.timedelta(minutes=5 * i), rnd.random() < share, wait, "warning")
            for rule, share, wait in (("r1", .8, 600), ("r2", .5, 0), ("r3", 1, 900), ("r4", 0, 300)) for i in range(60)
            if rnd.random() < .95]
    rows.sort(key=lambda r: r[1])
    schema = "rule string, window_start timestamp_ntz, firing boolean, for_seconds int, severity string"
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k:k + 40], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        q = (firing_islands(stream, 300).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    best = {}
    for r in spark.read.parquet(f"{root}/out").collect():
        key = r.rule, r.island_start
        best[key] = max(best.get(key, (0,)), (r.samples, r.island_last, r.duration_seconds, r.active_from))
    batch = TS.alert_sustained(spark.createDataFrame(rows, schema), 300).collect()
    assert best == {(r.rule, r.island_start): (r.samples, r.island_last, r.duration_seconds, r.active_from) for r in batch}
    assert len({rule for rule, _ in best}) == 3
