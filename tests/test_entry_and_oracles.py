"""Driver contract and Spark-vs-DuckDB agreement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from assaykit.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
FAST = ["v_gate", "read_payloads", "explode_batch", "batch_outcome", "v_post", "norm_c", "flatten_scores",
        "agg_failed_backlog", "agg_histogram_quantile", "ts_error_ratio", "ts_alert_sustained",
        "st_outbox_state", "q_stale_outbox", "pii_hmac", "j_insert_absent", "purge", "audit_row",
        "j_mark_flushed", "agg_violations_by_boundary", "replay", "st_dedup_window", "stream_outbox", "stream_assessments",
        "replay_store", "purge_store", "q_failed", "q_newest_failed", "q_failed_by_id", "ts_gauge_snapshot",
        "norm_registered", "pii_leak_tables",
        "stream_errors", "st_sweep", "sink_envelopes"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["payload_id", "provider", "stage", "error_kind", "n_pre", "n_post",
                          "n_assessments", "score_count"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sdf.columns
    s = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert s == d
