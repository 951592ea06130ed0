"""Scalar helpers: rescale, HMAC/redaction policies, backoff, transient errors."""

import hashlib
import hmac as std_hmac

import pytest
from pyspark.sql import functions as F

from assaykit.functions import pii, rescale, retry

SALT = "unit tests of the scrubbing functions use this salt"


def _val(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("v,preset,expected", [(5, "0-10", 50.0), (7, "0-10", 70.0), (2.5, "0-5", 50.0),
                                               (-5, "0-10", 0.0), (15, "0-10", 100.0), (42, "0-100", 42.0)])
def test_rescale_presets_clamp(spark, v, preset, expected):
    assert _val(spark, rescale.rescale_preset(F.lit(v), preset)) == pytest.approx(expected)


def test_hmac_matches_python(spark):
    for text in ["P123", "Jane Doe", "ü-ñ-日本", ""]:
        want = "sha256:" + std_hmac.new(SALT.encode(), text.encode(), hashlib.sha256).hexdigest()
        assert _val(spark, pii.hmac_sha256_hex(F.lit(text), SALT)) == want


def test_hmac_long_key(spark):
    key = "k" * 100
    want = "sha256:" + std_hmac.new(key.encode(), b"P123", hashlib.sha256).hexdigest()
    assert _val(spark, pii.hmac_sha256_hex(F.lit("P123"), key)) == want


def test_policies(spark):
    strict = pii.PiiPolicy(hash_salt=SALT)
    redact = pii.PiiPolicy(hash_salt=SALT, patient_id_strategy="redact", raw_input_strategy="redact")
    internal = pii.PiiPolicy(hash_salt=SALT, allow_internal_pii=True, store_patient_id_plaintext=True,
                             store_raw_for_replay=True)
    assert _val(spark, pii.patient_id_for_storage(F.lit("P123"), strict)).startswith("sha256:")
    assert _val(spark, pii.patient_id_for_storage(F.lit("P123"), redact)) == "[REDACTED]"
    assert _val(spark, pii.patient_id_for_storage(F.lit("P123"), internal)) == "P123"
    assert _val(spark, pii.raw_input_for_storage(F.lit("raw"), internal)) == "raw"
    assert _val(spark, pii.raw_input_for_storage(F.lit("raw"), redact)) == "[REDACTED]"
    # the edge scrubs plaintext once and never re-hashes a stored hash
    stored = pii.patient_id_for_storage(F.lit("P123"), strict)
    assert _val(spark, pii.patient_id_external(stored, strict)) == _val(spark, stored)
    assert _val(spark, pii.patient_id_external(F.lit("P123"), internal)) == _val(spark, stored)


def test_policy_guards():
    with pytest.raises(ValueError):
        pii.PiiPolicy(store_patient_id_plaintext=True)
    with pytest.raises(ValueError):
        pii.PiiPolicy(patient_id_strategy="rot13")
    with pytest.raises(ValueError):
        pii.PiiPolicy(hash_salt="short")
    with pytest.raises(ValueError):
        pii.PiiPolicy(hash_salt=SALT, enabled=False)
    assert pii.PiiPolicy(hash_salt="", patient_id_strategy="redact", raw_input_strategy="redact")


def test_field_rules(spark):
    raw = '{"patient": {"id": "P1", "name": "Jane", "dob": "1990"}, "assessment": {"type": "t"}}'
    df = spark.createDataFrame([(raw,)], "raw string")
    out = df.select(pii.scrub_fields("raw", [("name", "redact"), ("dob", "hash")], SALT).alias("o")).first()["o"]
    assert "Jane" not in out and '"name":"[REDACTED]"' in out and '"id":"P1"' in out
    assert '"dob":"sha256:' in out


def test_backoff_range_and_determinism(spark):
    df = spark.range(200).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    rows = df.select("n", retry.backoff_ms(F.col("n"), F.col("id")).alias("d")).collect()
    for r in rows:
        capped = min(100 * 2 ** (r["n"] - 1), 5000)
        jitter = capped // 4
        assert capped - jitter // 2 <= r["d"] < capped - jitter // 2 + max(jitter, 1)
    again = df.select(retry.backoff_ms(F.col("n"), F.col("id")).alias("d")).collect()
    assert [r["d"] for r in rows] == [r["d"] for r in again]


@pytest.mark.parametrize("msg,expected", [
    ("Connection refused (os error 111)", True), ("connection reset by peer", True), ("Broken pipe", True),
    ("operation timed out", True), ("statement timeout", True), ("could not serialize access due to x", True),
    ("FATAL: too many connections for role", True), ("pool timed out while waiting", True),
    ("duplicate key value violates unique constraint", False), ("syntax error", False)])
def test_transient(spark, msg, expected):
    assert _val(spark, retry.is_transient(F.lit(msg))) is expected


def test_serialization_errors_never_transient(spark):
    assert _val(spark, retry.is_transient(F.lit("timeout"), F.lit(True))) is False
