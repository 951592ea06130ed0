"""The sink registry in the tasks, and the scan for plain identifiers."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.operators import joins as J, leaks
from assaykit.operators.sinks import SinkRegistry, stdout_sender
from assaykit.plans import catalog, pipeline as P
from assaykit.session import scratch_dir


def flaky(fails):
    """A sink type that fails the first times for some rows."""
    def make(options):
        seen = {}

        def send(text):
            seen[text] = seen.get(text, 0) + 1
            if options["name"] in text and seen[text] <= fails:
                raise ConnectionError("no answer")
        return send
    return make


def test_registry_sends_in_tasks_with_retries(spark):
    registry = SinkRegistry([{"name": "a", "sink_type": "twice", "options": {"name": "x"}},
                             {"name": "b", "sink_type": "never", "options": {"name": "x"}},
                             {"name": "c", "sink_type": "unheard of"}, {"name": "d", "sink_type": "twice", "options": {}}],
                            {"twice": flaky(2), "never": flaky(99)}, enabled=("a", "b", "c"), base_ms=1)
    assert list(registry.sinks) == ["a", "b"]
    rows = spark.createDataFrame([("1", '"x"'), ("2", '"y"')], "assessment_id string, assessment_json string")
    fan = J.fan_out(rows, registry.frame(spark))
    got = sorted(tuple(r) for r in registry.deliver(fan).collect())
    assert got == [("1", "a", True, None, 3), ("1", "b", False, "ConnectionError: no answer", 3),
                   ("2", "a", True, None, 1), ("2", "b", True, None, 1)]
    assert registry.deliver(fan.limit(0)).count() == 0
    assert SinkRegistry([{"name": "c", "sink_type": "unheard of"}]).frame(spark).count() == 0


def test_stdout_sender_prints_indented(capsys):
    stdout_sender({})('{"id":"é","n":[1]}')
    assert capsys.readouterr().out == '{\n  "id": "é",\n  "n": [\n    1\n  ]\n}\n'


def test_planted_identifier_is_found_in_any_column(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_IDS", 3)
    ids = spark.createDataFrame([(f"P-{i}",) for i in range(10)] + [(None,), ("",), ("P-1",)], "pid string")
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("clean", at, [("k", 1.0)], {"a": "b"}, None), ("see P-3.", at, [("P-4", 1.0)], {"a": "x"}, "P-30 xP-3 P-3x"),
         ("P-1", at, [("k", 1.0)], {"P-9": "P-9"}, "P-2,P-3,P-4")],
        "a string, b timestamp, c array<struct<d: string, v: double>>, m map<string, string>, `odd name.x` string")
    got = {r.column_name: (r.n_rows, r.n_leaks) for r in leaks.leak_counts(df, ids, "pid").collect()}
    assert got == {"a": (3, 2), "b": (3, 0), "c": (3, 1), "m": (3, 1), "odd name.x": (3, 1)}
    assert {r.n_leaks for r in leaks.leak_counts(df, ids.limit(0), "pid").collect()} == {0}
    none = leaks.scan_tables({"t": df.limit(0), "u": df}, ids, "pid").filter("table_name = 't'").collect()
    assert {(r.n_rows, r.n_leaks) for r in none} == {(0, 0)}
    monkeypatch.setattr(leaks, "MOST_IDS", 5)
    with pytest.raises(ValueError):
        leaks.leak_counts(df, ids.withColumn("pid", F.upper("pid")), "pid")


def test_clean_cells_are_read_together():
    class Counting:
        def __init__(self, ids):
            self.made, self.read = leaks._automaton(ids), []

        def iter(self, text):
            self.read.append(text)
            return self.made.iter(text)

    a = Counting(["U1", "U22", "2\n3"])
    assert leaks._leaks(pa.array(["x", None, "y U9", "x", ""] * 50), [a]) == 0 and len(a.read) == 1
    # an identifier at the edge of a cell, one that several cells hold, one that only two cells together hold
    assert leaks._leaks(pa.array(["U1", "a", "aU1", "U1", "-U22", None, "U222"]), [a]) == 3
    assert leaks._leaks(pa.array(["12", "3"]), [Counting(["2\n3", "2"]), Counting(["x"])]) == 0
    assert leaks._leaks(pa.array([], pa.string()), [a]) == leaks._leaks(pa.array([None], pa.string()), [a]) == 0


def test_the_stages_run_once_for_both_policies(spark, monkeypatch):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 7, "view", 5.0, '{"k": 3}') for i in range(1, 6)]
    root = scratch_dir(spark, "t-leak-tables")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(f"{root}/events.parquet")
    runs, decided = [], P.decided
    monkeypatch.setattr(P, "decided", lambda *a, **b: runs.append(1) or decided(*a, **b))
    out = {(r.policy, r.table_name, r.column_name): r.n_leaks for r in catalog.QUERIES["pii_leak_tables"](spark, root).collect()}
    assert len(runs) == 1
    assert out["plain", "assessments", "patient_id"] > 0 and out["plain", "outbox", "payload"] > 0
    assert not any(n for (policy, *_), n in out.items() if policy == "strict")
