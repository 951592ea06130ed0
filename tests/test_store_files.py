"""The store's files: key lookup, versions, replaced rows, reads by time, facet and id, purge and replay."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.plans import fileindex as X
from assaykit.plans.store import TableStore
from assaykit.session import scratch_dir

FAILED = ("id string, provider string, raw_input string, error_kind string, error_detail string, input_hash string, "
          "replayed boolean, replayed_at timestamp_ntz, created_at timestamp_ntz")
DAY = dt.datetime(2024, 1, 1)


def failed(spark, *items):
    """Failed records from (hash, provider, day[, kind])."""
    rows = [(f"id-{h}-{p}", p, "raw", *(k or ("parse",)), "{}", h, False, None, DAY + dt.timedelta(days=d))
            for h, p, d, *k in items]
    return spark.createDataFrame(rows, FAILED)


def new_store(spark):
    return TableStore(spark, scratch_dir(spark, "t-files"))


def test_key_filter_has_no_misses_and_few_wrong_hits():
    rng = np.random.default_rng(1)
    held, others = rng.integers(-2 ** 63, 2 ** 63, 5_000), rng.integers(-2 ** 63, 2 ** 63, 200_000)
    made = X.make_filter(held)
    assert len(made) <= 5_000 * X.BITS // 8
    assert set(X.passing(made, held)) == set(held)
    assert len(X.passing(made, others)) < 40
    assert len(X.passing(X.make_filter(held[:1]), held[:1])) == 1


def test_failures_without_a_provider_are_stored_once(spark):
    store = new_store(spark)
    for batch in range(3):
        store.write_table_batch("failed_records", failed(spark, ("h1", None, 0), ("h1", None, 0), ("h2", "p", 0)), batch)
    assert sorted((r.input_hash, r.provider) for r in store.read("failed_records").collect()) == [("h1", None), ("h2", "p")]


def test_a_lookup_opens_only_files_that_may_hold_its_keys(spark):
    store = new_store(spark)
    for batch in range(24):
        store.write_table_batch("failed_records", failed(spark, *[(f"h{batch}-{i}", "p", 0) for i in range(40)]), batch)
    files = store.files("failed_records").count()
    fresh = failed(spark, *[(f"new{i}", "p", 0) for i in range(200)])
    key = X.key_hash(X.row_key(["input_hash", "provider"]))
    assert files >= 24 and len(store.holding("failed_records", fresh.select(key))) <= files // 20
    assert len(store.holding("failed_records", failed(spark, ("h7-3", "p", 0)).select(key))) == 1
    again = failed(spark, ("h7-3", "p", 5), ("h23-39", "p", 5), ("h23-39", "q", 5))
    store.write_table_batch("failed_records", again, 24)
    assert store.read("failed_records").count() == 24 * 40 + 1


def test_large_batches_are_joined_with_all_keys(spark, monkeypatch):
    monkeypatch.setattr(X, "LOOKUP_HASHES", 3)
    store = new_store(spark)
    rows = [(f"h{i}", "p", i % 3) for i in range(10)]
    store.write_table_batch("failed_records", failed(spark, *rows), 0)
    store.write_table_batch("failed_records", failed(spark, *rows, ("h10", "p", 0)), 1)
    assert store.read("failed_records").count() == 11


def test_versions_stay_as_they_were(spark):
    store = new_store(spark)
    store.write_table_batch("failed_records", failed(spark, ("h1", "p", 0)), 0)
    before = store.version()
    store.write_table_batch("failed_records", failed(spark, ("h2", "p", 0)), 1)
    assert store.read("failed_records", before).count() == 1 and store.read("failed_records").count() == 2


def test_an_attempt_without_its_log_is_not_seen(spark):
    store = new_store(spark)
    store.write_table_batch("failed_records", failed(spark, ("h1", "p", 0)), 0)
    store.begin(1)
    store._write("failed_records", failed(spark, ("h2", "p", 0)), 1)        # fails before its commit
    assert store.read("failed_records").count() == 1
    store.write_table_batch("failed_records", failed(spark, ("h3", "p", 0)), 1)
    assert sorted(r.input_hash for r in store.read("failed_records").collect()) == ["h1", "h3"]


def test_replaced_rows(spark):
    store = new_store(spark)
    store.write_table_batch("failed_records", failed(spark, *[(f"h{i}", "p", 0) for i in range(5)]), 0)
    before = store.version()
    for turn, batch in (("h1", 1), ("h1", 2), ("h3", 3)):
        rows = store.read("failed_records", located=True).filter(F.col("input_hash") == turn)
        assert store.begin(batch)
        store.replace_rows("failed_records", rows.withColumns({"replayed": F.lit(True), "error_kind": F.lit(f"v{batch}")}),
                           batch)
        store._commit(batch)
    got = {r.input_hash: (r.replayed, r.error_kind) for r in store.read("failed_records").collect()}
    assert store.read("failed_records").count() == 5
    assert got == {"h0": (False, "parse"), "h1": (True, "v2"), "h2": (False, "parse"), "h3": (True, "v3"),
                   "h4": (False, "parse")}
    assert not any(r.replayed for r in store.read("failed_records", before).collect())


@pytest.fixture(scope="module")
def many(spark):
    """Thirty daily batches of two providers in turn."""
    store = new_store(spark)
    for day in range(30):
        store.write_table_batch("failed_records", failed(
            spark, *[(f"h{day}-{i}", f"p{day % 2}", day, "parse" if day % 3 else "validation") for i in range(4)]), day)
    return store


def test_reads_open_the_files_that_may_match(many):
    whole = many.read("failed_records")
    n = len(whole.inputFiles())
    one = many.read("failed_records", provider="p1")
    assert len(one.inputFiles()) == n // 2 and {r.provider for r in one.collect()} == {"p1"} and one.count() == 60
    both = many.read("failed_records", provider="p1", error_kind="validation")
    assert len(both.inputFiles()) == 5 and both.count() == 20
    recent = many.read("failed_records", since=DAY + dt.timedelta(days=28))
    assert len(recent.inputFiles()) == 2 and recent.count() == 8
    old = many.read("failed_records", before=DAY + dt.timedelta(days=2))
    assert len(old.inputFiles()) == 2 and old.count() == 8
    by_id = many.read("failed_records", id="id-h17-2-p1")
    assert len(by_id.inputFiles()) <= 2 and [r.input_hash for r in by_id.collect()] == ["h17-2"]
    assert many.read("failed_records", id="nobody").count() == 0
    assert many.read("failed_records", replayed=False).count() == 120 and many.read("failed_records", replayed=True).count() == 0


def test_newest_rows_stop_when_no_other_file_matters(many):
    rows = many.newest("failed_records", 6)
    assert [r.input_hash for r in rows.collect()] == ["h29-0", "h29-1", "h29-2", "h29-3", "h28-0", "h28-1"]
    assert len(rows.inputFiles()) <= 3
    some = many.newest("failed_records", 5, provider="p0")
    assert [r.input_hash for r in some.collect()] == ["h28-0", "h28-1", "h28-2", "h28-3", "h26-0"]
    assert many.newest("failed_records", 1000).count() == 120


def test_the_log_holds_no_key_filters_and_the_commit_reads_no_stored_rows(spark):
    store = new_store(spark)
    store.begin(0)
    store._write("failed_records", failed(spark, *[(f"h{i}", "p", 0) for i in range(40)]), 0)
    read = [f for part in store._done for f in part.inputFiles()]
    assert read and all("/_index/" in f for f in read)
    store._commit(0)
    assert "key_filter" not in store.log().columns
    key = X.key_hash(X.row_key(["input_hash", "provider"]))
    assert len(store.holding("failed_records", failed(spark, ("h7", "p", 0)).select(key))) == 1
    assert store.holding("failed_records", failed(spark, ("other", "p", 0)).select(key)) == []
    assert store.read("failed_records", id="id-h7-p").count() == 1
