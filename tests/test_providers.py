"""Provider adapters on the three fixture payloads (scaling, grouping, PHI absence)."""

import hashlib
import hmac

from pyspark.sql import functions as F

from assaykit.functions import pii
from assaykit.plans import pipeline as P

PROVIDER_A = """{
  "patient": {"id": "QX-77", "name": "Ada Sample", "dob": "1971-02-03"},
  "assessment": {"type": "sleep_review",
                 "scores": {"latency": 3, "rest": 9, "waking": 5.5},
                 "notes": "Falls asleep within the hour"}
}"""
PROVIDER_B = """{"patient_id": "QX-78", "patient_name": "Bo Sample", "assessment_type": "reaction",
  "score_speed": 61, "score_recall": 47.5, "notes": "Second sitting of the week"}"""
PROVIDER_C = """patient_id,assessment_date,metric_name,metric_value,category
QX-79,2023-03-09,balance,2,motor
QX-79,2023-03-09,grip,8.5,motor
"""

PLAIN = pii.PiiPolicy(hash_salt="s" * 32, allow_internal_pii=True, store_patient_id_plaintext=True)


def _scores(g):
    a = P.assessment_rows(g)
    return {(r["dimension"]): r["value"] for r in
            a.select(F.explode("scores").alias("s")).select("s.*").collect()}


def test_provider_a_scales_by_ten(spark, payloads):
    g = P.run_gate(payloads(("provider_a", PROVIDER_A)), P.GateConfig(PLAIN))
    row = g.first()
    assert row["stage"] == "ok"
    assert row["source_format"] == "nested_json"
    assert _scores(g) == {"latency": 30.0, "rest": 90.0, "waking": 55.0}
    a = P.assessment_rows(g).first()
    assert a["patient_id"] == "QX-77" and a["assessment_type"] == "sleep_review"
    assert a["version"] == "1.0" and a["source_provider"] == "provider_a"
    # no date in the payload: the ingest time is used
    assert a["assessment_date"] == a["ingested_at"]


def test_provider_b_keeps_values(spark, payloads):
    g = P.run_gate(payloads(("provider_b", PROVIDER_B)), P.GateConfig(PLAIN))
    assert g.first()["source_format"] == "flat_kv"
    assert _scores(g) == {"speed": 61.0, "recall": 47.5}


def test_provider_c_groups_rows(spark, payloads):
    g = P.run_gate(payloads(("provider_c", PROVIDER_C)), P.GateConfig(PLAIN))
    a = P.assessment_rows(g).collect()
    assert len(a) == 1
    assert [(s["dimension"], s["value"]) for s in a[0]["scores"]] == [("balance", 20.0), ("grip", 85.0)]
    assert str(a[0]["assessment_date"]) == "2023-03-09 00:00:00"
    assert a[0]["assessment_type"] == "motor"


def test_provider_c_groups_by_key_and_keeps_duplicates(spark, payloads):
    csv = ("category,metric_value,metric_name,assessment_date,patient_id,extra\n"
           "x,1,m,2024-1-5,P1,zz\nx,1,m,2024-1-5,P1,zz\ny,2,n,2024-01-05,P1,zz\n")
    g = P.run_gate(payloads(("provider_c", csv)), P.GateConfig(PLAIN))
    a = P.assessment_rows(g).orderBy("assessment_type").collect()
    assert g.first()["stage"] == "ok"
    assert [len(r["scores"]) for r in a] == [2, 1]
    assert str(a[0]["assessment_date"]) == "2024-01-05 00:00:00"


def test_phi_never_reaches_outputs(spark, payloads):
    g = P.run_gate(payloads(("provider_a", PROVIDER_A), ("provider_b", PROVIDER_B)), P.GateConfig(PLAIN))
    a = P.assessment_rows(g)
    blob = "".join(r[0] for r in P.outbox_rows(a).select("payload").collect())
    assert "Ada Sample" not in blob and "1971-02-03" not in blob and "asleep" not in blob
    assert "patientId" in blob and "assessmentType" in blob and "sourceProvider" in blob


def test_strict_policy_hashes_patient(spark, payloads):
    salt = "a salt that only this provider test makes use of"
    g = P.run_gate(payloads(("provider_b", PROVIDER_B)), P.GateConfig(pii.PiiPolicy(hash_salt=salt)))
    pid = P.assessment_rows(g).first()["patient_id"]
    assert pid == "sha256:" + hmac.new(salt.encode(), b"QX-78", hashlib.sha256).hexdigest()
