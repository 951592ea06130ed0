"""What a batch leaves on disk while it is written and afterwards."""

import glob
import os
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from assaykit.plans import pipeline as P
from assaykit.plans.store import TableStore
from assaykit.session import CLEAN_SHUFFLES, scratch_dir, written_parquet

B = '{"patient_id": "P%d", "assessment_type": "t", "score_x": 5}'


def shuffle_files(spark):
    top = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or "/tmp"
    # the folder of this session's block manager is the newest
    own = max(glob.glob(f"{top}/blockmgr-*"), key=os.path.getmtime, default=None)
    return glob.glob(f"{own}/*/shuffle_*.data") if own else []


def test_a_write_lets_its_shuffle_go(spark):
    was = spark.conf.get(CLEAN_SHUFFLES)
    kept = []                                               # a frame that is still held must not keep its shuffle
    before = set(shuffle_files(spark))
    for turn in range(3):
        rows = spark.range(1000).repartition(4, "id").withColumn("t", F.lit(turn))
        kept.append(rows)
        path = scratch_dir(spark, "t-shuffle")
        written_parquet(rows, path)
    for _ in range(50):
        if not set(shuffle_files(spark)) - before:
            break
        time.sleep(0.1)
    assert not set(shuffle_files(spark)) - before
    assert spark.conf.get(CLEAN_SHUFFLES) == was
    assert spark.read.parquet(path).count() == kept[0].count() == 1000      # and may be read again


def test_a_batch_holds_no_text_of_accepted_payloads_and_frees_what_was_read(spark, payloads, monkeypatch):
    rows = payloads(*[("provider_b", B % i) for i in range(5)], ("provider_b", "bad"), (None, "who"))
    store = TableStore(spark, scratch_dir(spark, "t-disk"))
    texts, held = [], []
    kept, let_go = TableStore._kept, TableStore._let_go

    def seen(self, df):
        out = kept(self, df)
        if "raw" in out.columns:
            texts.extend(out.filter("raw IS NOT NULL").select("raw").toPandas()["raw"])
        return out

    def freed(self, n, last=None):
        let_go(self, n, last)
        held.append([spark.read.schema("id string").parquet(f"{self._work}/{k + 1}").count() for k in range(self._held)])
    monkeypatch.setattr(TableStore, "_kept", seen)
    monkeypatch.setattr(TableStore, "_let_go", freed)
    store.write_gate_batch(P.run_gate(rows), 0)
    assert sorted(texts) == ["bad", "who"]
    # the gate until its last reader, what each table keeps until it is written, the assessments for all three of theirs
    assert held == [[7, 0], [7, 0, 0], [0, 0, 0, 5], [0, 0, 0, 0]]
    assert store.read("assessments").count() == store.read("outbox").count() == 5
    assert {r.provider for r in store.read("failed_records").collect()} == {"provider_b", None}
    store.write_gate_batch(P.run_gate(rows), 1)             # everything is stored already
    assert store.read("assessments").count() == 5 and store.read("failed_records").count() == 2
    for f in glob.glob(f"{store.root}/outbox/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        assert all(meta.row_group(g).column(0).compression == "ZSTD" for g in range(meta.num_row_groups))
