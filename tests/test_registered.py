"""Declared providers inside the gate, and field rules on stored payloads."""

import datetime as dt
import json

import pytest

from assaykit.functions import pii
from assaykit.operators.normalize import ScoreSpec
from assaykit.operators.providers import json_provider, python_provider
from assaykit.plans import pipeline as P

INTERNAL = pii.PiiPolicy(hash_salt="s" * 32, allow_internal_pii=True, store_patient_id_plaintext=True,
                         store_raw_for_replay=True, provider_fields={"provider_b": [("patient_name", "hash"), ("notes", "redact")]})
SPEC = ScoreSpec("provider_d", "$.who.id", "$.kind", "$.marks", "$.at", scale="0-5")


def reader():
    def read(raw):                  # local, so that it travels to the workers by value
        who, *marks = raw.split("|")
        return [{"patient_id": who, "assessment_type": "t", "assessment_date": "2024-05-01T10:00:00+02:00",
                 "scores": [{"dimension": str(i), "value": float(m)} for i, m in enumerate(marks)]}]
    return read


CONFIG = P.GateConfig(INTERNAL, declared=(json_provider(SPEC), python_provider("provider_e", "piped", reader())))


def gate(payloads, provider, *raws, config=CONFIG):
    rows = P.run_gate(payloads(*[(provider, r) for r in raws]), config).orderBy("payload_id").collect()
    return rows if len(rows) > 1 else rows[0]


def test_declared_json_provider_takes_every_stage(payloads):
    good = '{"who": {"id": "P1"}, "kind": "k", "marks": {"a": 2.5, "b": 9, "c": -1}, "at": "2024-01-02T03:04:05Z"}'
    r = gate(payloads, "provider_d", good)
    a, = r["assessments"]
    assert (r["stage"], r["source_format"], a["patient_id"], a["assessment_date"]) == (
        "ok", "declared_json", "P1", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert {s["dimension"]: s["value"] for s in a["scores"]} == {"a": 50.0, "b": 100.0, "c": 0.0}
    bad = gate(payloads, "provider_d", good + " x", "", '{"kind": 7, "marks": []}', good.replace("2.5", '"2.5"'),
               good.replace("2024-01-02T03:04:05Z", "soon"), good.replace('{"a": 2.5, "b": 9, "c": -1}', "{}"),
               good.replace('"P1"', '""'))
    assert [(b["stage"], b["error_kind"]) for b in bad] == [
        ("pre", "validation"), ("pre", "validation"), ("pre", "validation"), ("deep", "parse"), ("deep", "parse"),
        ("post", "validation"), ("post", "validation")]
    assert [v["field"] for v in bad[2]["pre_violations"]] == ["who.id", "kind", "marks"]


def test_python_provider_reads_in_batches_and_refuses(payloads):
    ok, high, refused, empty = gate(payloads, "provider_e", "P9|5|7.5", "P9|101", "P9|x", "")
    a, = ok["assessments"]
    assert (ok["source_format"], a["assessment_date"]) == ("piped", dt.datetime(2024, 5, 1, 8))
    assert [(s["dimension"], s["value"]) for s in a["scores"]] == [("0", 5.0), ("1", 7.5)]
    assert [(r["stage"], r["error_kind"]) for r in (high, refused, empty)] == [
        ("post", "validation"), ("deep", "parse"), ("pre", "validation")]


def test_only_python_providers_payloads_meet_python(payloads):
    rows = payloads(("provider_b", "x"))
    plain = P.run_gate(rows, P.GateConfig(INTERNAL, declared=(json_provider(SPEC),)))
    assert "MapInArrow" not in plain._jdf.queryExecution().toString()


def test_allow_list_and_names(payloads):
    some = P.GateConfig(INTERNAL, ("provider_d",), CONFIG.declared)
    assert gate(payloads, "provider_e", "P|1", config=some)["error_kind"] == "unknown_provider"
    assert gate(payloads, "provider_b", "{}", config=some)["error_kind"] == "unknown_provider"
    with pytest.raises(ValueError):
        python_provider("provider_a", "x", reader())


def test_field_rules_on_what_is_stored(payloads):
    raw = '{"patient_id": "P1", "patient_name": "Jo", "notes": "n", "assessment_type": "t"}'
    g = P.run_gate(payloads(("provider_b", raw), ("provider_d", "{}")), CONFIG)
    stored = {r["provider"]: r["raw_input"] for r in P.failed_rows(g, INTERNAL).collect()}
    kept = json.loads(stored["provider_b"])
    assert kept["patient_id"] == "P1" and kept["notes"] == "[REDACTED]" and kept["patient_name"].startswith("sha256:")
    assert stored["provider_d"] == "{}"
    assert {r["raw_input"] for r in P.violation_rows(g, INTERNAL).collect()} == set(stored.values())
