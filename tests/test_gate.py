"""Staged gating: first failure wins, kinds, violations, strict JSON."""

import pytest

from assaykit.plans import pipeline as P


def _one(payloads, provider, raw):
    return P.run_gate(payloads((provider, raw))).first()


def test_malformed_json_is_a_body_violation(payloads):
    r = _one(payloads, "provider_a", "not json")
    assert (r["stage"], r["error_kind"]) == ("pre", "validation")
    assert [v["field"] for v in r["pre_violations"]] == ["body"]


def test_empty_body(payloads):
    r = _one(payloads, "provider_b", "")
    assert r["pre_violations"][0]["message"] == "input body is empty"


@pytest.mark.parametrize("raw", ['{"a":1} x', '1], [2', '{"a":1},{"b":2}', '[1', '{"a":1}}'])
def test_trailing_or_broken_text_is_invalid_json(payloads, raw):
    r = _one(payloads, "provider_b", raw)
    assert r["stage"] == "pre" and r["pre_violations"][0]["expected"] == "valid JSON"


def test_out_of_range_score_is_post_violation(payloads):
    raw = '{"patient": {"id": "P1"}, "assessment": {"type": "t", "scores": {"x": 15.0}}}'
    r = _one(payloads, "provider_a", raw)
    assert (r["stage"], r["error_kind"]) == ("post", "validation")
    v = r["post_violations"][0]
    assert (v["field"], v["actual"], v["message"]) == ("scores[0].value", "150", "score value 150 out of 0-100 range")


def test_provider_a_structure_violations_in_order(payloads):
    r = _one(payloads, "provider_a", '{"patient": null, "assessment": {"type": 3}}')
    assert [(v["field"], v["actual"]) for v in r["pre_violations"]] == [
        ("patient.id", "null"), ("assessment.type", "missing or non-string"),
        ("assessment.scores", "missing or non-object")]


def test_provider_a_non_object_root(payloads):
    r = _one(payloads, "provider_a", "[1, 2]")
    assert [v["field"] for v in r["pre_violations"]] == ["patient", "assessment"]


def test_provider_a_numeric_id_actual_is_json(payloads):
    r = _one(payloads, "provider_a", '{"patient": {"id": 12}, "assessment": {"type": "t", "scores": {}}}')
    assert r["pre_violations"][0]["actual"] == "12"


def test_provider_a_string_score_is_parse_error(payloads):
    r = _one(payloads, "provider_a", '{"patient": {"id": "P"}, "assessment": {"type": "t", "scores": {"x": "7"}}}')
    assert (r["stage"], r["error_kind"]) == ("deep", "parse")


def test_provider_a_bad_date_is_parse_error(payloads):
    raw = '{"patient": {"id": "P"}, "assessment": {"date": "yesterday", "type": "t", "scores": {"x": 1}}}'
    assert _one(payloads, "provider_a", raw)["error_kind"] == "parse"


def test_provider_a_date_with_offset_is_utc(payloads):
    raw = '{"patient": {"id": "P"}, "assessment": {"date": "2024-01-01T02:00:07+02:00", "type": "t", "scores": {"x": 1}}}'
    r = _one(payloads, "provider_a", raw)
    assert str(r["assessments"][0]["assessment_date"]) == "2024-01-01 00:00:07"


def test_provider_b_requires_score_key(payloads):
    r = _one(payloads, "provider_b", '{"patient_id": "P", "assessment_type": "t"}')
    assert [v["field"] for v in r["pre_violations"]] == ["score_*"]


def test_provider_b_non_numeric_scores_only(payloads):
    r = _one(payloads, "provider_b", '{"patient_id": "P", "assessment_type": "t", "score_x": "85"}')
    assert (r["stage"], r["error_kind"]) == ("deep", "validation")
    assert r["field_errors"][0]["message"] == "at least one score_* field is required"


def test_provider_b_drops_non_numeric_keeps_numeric(payloads):
    r = _one(payloads, "provider_b", '{"patient_id": "P", "assessment_type": "t", "score_x": "85", "score_y": 50}')
    assert r["stage"] == "ok"
    assert [s["dimension"] for s in r["assessments"][0]["scores"]] == ["y"]


def test_provider_b_empty_dimension(payloads):
    r = _one(payloads, "provider_b", '{"patient_id": "P", "assessment_type": "t", "score_": 5}')
    assert r["post_violations"][0]["field"] == "scores[0].dimension"


def test_provider_c_missing_columns_in_expected_order(payloads):
    r = _one(payloads, "provider_c", "metric_name,patient_id\nx,P")
    assert [v["field"] for v in r["pre_violations"]] == ["assessment_date", "metric_value", "category"]


def test_provider_c_ragged_row_fails_payload(payloads):
    csv = "patient_id,assessment_date,metric_name,metric_value,category\nP,2024-01-01,m,1,c\nP,2024-01-01,m,1"
    assert _one(payloads, "provider_c", csv)["error_kind"] == "parse"


def test_provider_c_value_with_space_is_parse_error(payloads):
    csv = "patient_id,assessment_date,metric_name,metric_value,category\nP,2024-01-01,m, 6,c"
    assert _one(payloads, "provider_c", csv)["error_kind"] == "parse"


def test_provider_c_bad_date_fails_in_normalize(payloads):
    csv = "patient_id,assessment_date,metric_name,metric_value,category\nP,2024-02-30,m,6,c"
    r = _one(payloads, "provider_c", csv)
    assert (r["stage"], r["error_kind"]) == ("normalize", "parse")


def test_provider_c_header_only_succeeds_with_nothing(payloads):
    r = _one(payloads, "provider_c", "patient_id,assessment_date,metric_name,metric_value,category\n")
    assert r["stage"] == "ok" and r["assessments"] == [] and r["score_count"] == 0


def test_provider_c_quoted_cells(payloads):
    csv = 'patient_id,assessment_date,metric_name,metric_value,category\n"P,1",2024-01-01,"m ""q""",6,c'
    r = _one(payloads, "provider_c", csv)
    a = r["assessments"][0]
    assert a["scores"][0]["dimension"] == 'm "q"'


def test_unknown_provider(payloads):
    r = _one(payloads, "provider_q", "{}")
    assert (r["stage"], r["error_kind"], r["error_message"]) == ("provider", "unknown_provider",
                                                                 "unknown provider: provider_q")


def test_disabled_provider_is_unknown(spark, payloads):
    g = P.run_gate(payloads(("provider_c", "a,b")), P.GateConfig(enabled=("provider_a",)))
    assert g.first()["error_kind"] == "unknown_provider"


def test_audit_steps_follow_stages(payloads):
    import json
    r = _one(payloads, "provider_b", '{"patient_id": "P", "assessment_type": "t", "score_x": 5}')
    steps = [s["step"] for s in json.loads(r["transformations"])]
    assert steps == ["validate_pre_transform", "validate_input", "normalize", "validate_post_transform",
                     "validate_output", "pii_scrub"]


def test_payloads_of_one_split_are_dealt_to_all_cores_without_a_setting(spark):
    from assaykit.plans import pipeline as P
    kept = spark.conf.get(P.GATE_PARTITIONS_CONF)
    spark.conf.unset(P.GATE_PARTITIONS_CONF)
    try:
        one = spark.range(1000).coalesce(1)
        assert P.spread(one).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(P.GATE_PARTITIONS_CONF, kept)


def test_post_check_builds_no_lists_for_a_clean_payload(spark):
    # 'actual' is made by the list-building branch only: the plain test must answer for clean rows, and only for them
    from assaykit.operators import validate as V
    shape = ("provider string, assessments array<struct<patient_id: string, assessment_type: string, "
             "scores: array<struct<dimension: string, value: double, scale: string>>>>")

    def row(pid="P", kind="t", scores=(("x", 5.0, "0-100"),), provider="provider_b"):
        return provider, [("P", "t", [("y", 0.0, "0-100"), ("z", 100.0, "0-100")]), (pid, kind, scores and list(scores))]

    rows = [row(), row(None, None), row(scores=((None, 1.0, None),)), row(""), row(kind=""), row(scores=()), row(provider=""),
            row(scores=(("x", -0.5, "0-100"),)), row(scores=(("x", float("nan"), "0-100"),)), row(scores=(("x", None, "0-100"),)),
            row(scores=(("", 5.0, "0-100"),)), row(scores=(("x", 5.0, "0-10"),)), row(scores=None), ("provider_b", [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {shape}").repartition(1)
    got = [r[0] for r in df.sortWithinPartitions("i").selectExpr(f"transform({V.post()}, x -> x.field)").collect()]
    assert got == [[], [], [], ["patientId"], ["assessmentType"], ["scores"], ["metadata.sourceProvider"] * 2,
                   ["scores[0].value"], ["scores[0].value"], ["scores[0].value"], ["scores[0].dimension"], ["scores[0].scale"],
                   None, []]
    assert V.post().startswith("CASE WHEN NOT exists(")
