"""Boundary validation as SQL expressions over one payload row.

Every check returns an ``array<struct<field,expected,actual,message>>`` (or a
boolean for the typed "deep" parse), built with ``array_compact(array(CASE
...))`` so a payload's violations come out in the same order as the checks
are listed. Nothing here shuffles: each payload is validated where it lies.

Expressions refer to these columns of the payload row:
``raw`` (text), ``v`` (strict VARIANT parse of raw, JSON providers), ``m``
(the root object as ``map<string,variant>``, NULL when the root is not an
object), ``pm`` / ``am`` / ``sm`` (provider A's patient, assessment and
scores objects as maps), ``bsc`` (provider B's numeric scores),
``csv_header`` / ``csv_rows`` (parsed CSV, provider C), ``assessments``
(normalized output), ``provider``. Each object is turned into a map once and
every check reads from that map, instead of re-navigating the VARIANT per
check.
"""

from __future__ import annotations

from assaykit.functions.jsonx import is_numeric_sql
from assaykit.schemas import CSV_COLUMNS, TARGET_SCALE

# ---------------------------------------------------------------------------
# Violation texts
# ---------------------------------------------------------------------------
MSG_EMPTY = ("body", "non-empty input", "empty", "input body is empty")
MSG_BAD_JSON = ("body", "valid JSON", "invalid JSON", "JSON parse error: invalid JSON")
MSG_A_PATIENT = ("patient", "object", "missing", "provider_a requires 'patient' object")
MSG_A_PATIENT_ID = ("patient.id", "string", None, "patient.id is required and must be a string")
MSG_A_ASSESSMENT = ("assessment", "object", "missing", "provider_a requires 'assessment' object")
MSG_A_TYPE = ("assessment.type", "string", "missing or non-string", "assessment.type is required")
MSG_A_SCORES = ("assessment.scores", "object", "missing or non-object",
                "assessment.scores is required and must be an object")
MSG_B_PATIENT_ID = ("patient_id", "string", "missing", "patient_id is required")
MSG_B_TYPE = ("assessment_type", "string", "missing", "assessment_type is required")
MSG_B_SCORES = ("score_*", "at least one score_* key", "none found",
                "provider_b requires at least one score_* field")
MSG_B_NO_NUMERIC = ("score_*", "at least one score_* field is required")
MSG_C_EXPECTED = "column present in CSV header"
MSG_C_MISSING = "CSV is missing required column: "

# RFC 3339 date-time accepted by the typed parse of provider A's date
RFC3339_RE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
# decimal float text accepted by a strict f64 parser (no spaces, no suffixes)
FLOAT_RE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)(inf|infinity|nan))\z"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def violation(field: str, expected: str, actual: str, message: str, raw_sql=False) -> str:
    """named_struct of a violation; pass raw_sql=True when values are SQL snippets."""
    f = (lambda x: x) if raw_sql else _q
    return (f"named_struct('field', {f(field)}, 'expected', {f(expected)}, "
            f"'actual', {f(actual)}, 'message', {f(message)})")


def _fixed(t) -> str:
    return violation(*t)


EMPTY_ARRAY = f"filter(array({_fixed(MSG_EMPTY)}), x -> false)"
NO_VIOLATIONS = "CAST(array() AS array<struct<field: string, expected: string, actual: string, message: string>>)"


def _body_checks(structure: str) -> str:
    return (f"CASE WHEN octet_length(raw) = 0 THEN array({_fixed(MSG_EMPTY)}) "
            f"WHEN v IS NULL THEN array({_fixed(MSG_BAD_JSON)}) "
            f"ELSE {structure} END")


def _t(mp: str, key: str) -> str:
    """Variant type name of ``mp[key]`` (NULL when absent)."""
    return f"schema_of_variant(try_element_at({mp}, '{key}'))"


def _is_str(mp: str, key: str) -> str:
    return f"coalesce({_t(mp, key)} = 'STRING', false)"


def _opt_str(mp: str, key: str) -> str:
    """Absent, JSON null, or a string (an optional string field)."""
    return f"coalesce({_t(mp, key)} IN ('STRING', 'VOID'), true)"


def _present(mp: str, key: str) -> str:
    return f"(try_element_at({mp}, '{key}') IS NOT NULL)"


def pre_a() -> str:
    pid_actual = "coalesce(to_json(try_element_at(pm, 'id')), 'null')"
    pid = violation(_q(MSG_A_PATIENT_ID[0]), _q(MSG_A_PATIENT_ID[1]), pid_actual,
                    _q(MSG_A_PATIENT_ID[3]), raw_sql=True)
    has_assessment = _present("m", "assessment")
    structure = ("array_compact(array("
                 f"CASE WHEN NOT {_present('m', 'patient')} THEN {_fixed(MSG_A_PATIENT)} "
                 f"WHEN NOT {_is_str('pm', 'id')} THEN {pid} END, "
                 f"CASE WHEN NOT {has_assessment} THEN {_fixed(MSG_A_ASSESSMENT)} END, "
                 f"CASE WHEN {has_assessment} AND NOT {_is_str('am', 'type')} "
                 f"THEN {_fixed(MSG_A_TYPE)} END, "
                 f"CASE WHEN {has_assessment} AND sm IS NULL THEN {_fixed(MSG_A_SCORES)} END))")
    return _body_checks(structure)


def pre_b() -> str:
    has_score_key = "coalesce(exists(map_keys(m), k -> startswith(k, 'score_')), false)"
    structure = ("array_compact(array("
                 f"CASE WHEN NOT {_is_str('m', 'patient_id')} THEN {_fixed(MSG_B_PATIENT_ID)} END, "
                 f"CASE WHEN NOT {_is_str('m', 'assessment_type')} THEN {_fixed(MSG_B_TYPE)} END, "
                 f"CASE WHEN NOT {has_score_key} THEN {_fixed(MSG_B_SCORES)} END))")
    return _body_checks(structure)


def pre_c() -> str:
    expected = ", ".join(_q(c) for c in CSV_COLUMNS)
    missing = (f"transform(filter(array({expected}), c -> NOT coalesce(array_contains(csv_header, c), false)), "
               f"c -> named_struct('field', c, 'expected', {_q(MSG_C_EXPECTED)}, 'actual', 'missing', "
               f"'message', concat({_q(MSG_C_MISSING)}, c)))")
    return f"CASE WHEN octet_length(raw) = 0 THEN array({_fixed(MSG_EMPTY)}) ELSE {missing} END"


def deep_a() -> str:
    """Typed parse of provider A: every declared field has its declared type."""
    date = "try_element_at(am, 'date')"
    date_ok = (f"(coalesce(schema_of_variant({date}) = 'VOID', true) OR "
               f"(schema_of_variant({date}) = 'STRING' AND "
               f"try_variant_get({date}, '$', 'string') rlike {_q(RFC3339_RE)} AND "
               f"try_variant_get({date}, '$', 'timestamp') IS NOT NULL))")
    scores_numeric = f"forall(map_values(sm), x -> {is_numeric_sql('x')})"
    return " AND ".join([
        "pm IS NOT NULL", _is_str("pm", "id"), _opt_str("pm", "name"), _opt_str("pm", "dob"),
        "am IS NOT NULL", _is_str("am", "type"), "sm IS NOT NULL", f"coalesce({scores_numeric}, false)",
        _opt_str("am", "notes"), date_ok,
    ])


def deep_b() -> str:
    return " AND ".join([
        "m IS NOT NULL", _is_str("m", "patient_id"), _is_str("m", "assessment_type"),
        _opt_str("m", "patient_name"), _opt_str("m", "notes"),
    ])


def deep_c() -> str:
    """Every data row has the header's width and a float metric value."""
    return "forall(csv_rows, r -> r.width_ok AND r.value_ok)"


def rust_float_text(x: str) -> str:
    """Display text of a double the way a Rust ``{}`` prints it (150 not 150.0)."""
    return (f"CASE WHEN isnan({x}) THEN 'NaN' WHEN {x} = double('inf') THEN 'inf' "
            f"WHEN {x} = double('-inf') THEN '-inf' "
            f"WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN cast(cast({x} AS bigint) AS string) "
            f"ELSE cast({x} AS string) END")


def post() -> str:
    """Unified-output checks over all assessments of the payload, concatenated.

    One plain test tells the payloads without a violation, so that only the others build the lists, in which each
    check costs several arrays a score.
    """
    may_fail = ("exists(assessments, a -> a.scores IS NULL OR size(a.scores) = 0 OR coalesce(a.patient_id = '', false) "
                "OR coalesce(a.assessment_type = '', false) OR coalesce(provider = '', false) "
                "OR exists(a.scores, s -> NOT coalesce(s.value BETWEEN 0.0D AND 100.0D, false) "
                f"OR coalesce(s.dimension = '', false) OR coalesce(s.scale != '{TARGET_SCALE}', false)))")
    val = rust_float_text("s.value")
    per_score = ("flatten(transform(a.scores, (s, i) -> array_compact(array("
                 f"CASE WHEN NOT coalesce(s.value BETWEEN 0.0D AND 100.0D, false) THEN "
                 f"named_struct('field', concat('scores[', i, '].value'), 'expected', '0.0-100.0', "
                 f"'actual', {val}, 'message', concat('score value ', {val}, ' out of 0-100 range')) END, "
                 "CASE WHEN s.dimension = '' THEN named_struct('field', concat('scores[', i, '].dimension'), "
                 "'expected', 'non-empty string', 'actual', 'empty', "
                 "'message', 'score dimension must not be empty') END, "
                 f"CASE WHEN s.scale != '{TARGET_SCALE}' THEN named_struct('field', concat('scores[', i, '].scale'), "
                 f"'expected', '{TARGET_SCALE}', 'actual', s.scale, "
                 "'message', 'all scores must be on 0-100 scale after normalization') END))))")
    head = ("array_compact(array("
            f"CASE WHEN a.patient_id = '' THEN {violation('patientId', 'non-empty string', 'empty', 'patientId must not be empty after normalization')} END, "
            f"CASE WHEN a.assessment_type = '' THEN {violation('assessmentType', 'non-empty string', 'empty', 'assessmentType must not be empty after normalization')} END, "
            f"CASE WHEN size(a.scores) = 0 THEN {violation('scores', 'at least one score', 'empty', 'scores array must not be empty after normalization')} END))")
    tail = ("array_compact(array(CASE WHEN provider = '' THEN "
            f"{violation('metadata.sourceProvider', 'non-empty string', 'empty', 'source provider must be recorded')} END))")
    return (f"CASE WHEN NOT {may_fail} THEN {NO_VIOLATIONS} "
            f"ELSE flatten(transform(assessments, a -> concat({head}, {per_score}, {tail}))) END")


def output_errors() -> str:
    """Invariant re-check of each unified record (field + message pairs)."""
    val = rust_float_text("s.value")
    return ("flatten(transform(assessments, a -> concat(array_compact(array("
            "CASE WHEN a.patient_id = '' THEN named_struct('field', 'patientId', 'message', 'patientId is required') END, "
            "CASE WHEN a.assessment_type = '' THEN named_struct('field', 'assessmentType', 'message', 'assessmentType is required') END, "
            "CASE WHEN size(a.scores) = 0 THEN named_struct('field', 'scores', 'message', 'at least one score is required') END)), "
            "flatten(transform(a.scores, (s, i) -> array_compact(array("
            "CASE WHEN NOT coalesce(s.value BETWEEN 0.0D AND 100.0D, false) THEN named_struct('field', "
            f"concat('scores[', i, '].value'), 'message', concat('score must be between 0 and 100, got ', {val})) END, "
            "CASE WHEN s.dimension = '' THEN named_struct('field', concat('scores[', i, '].dimension'), "
            "'message', 'dimension is required') END)))))))")


def violations_to_errors(col: str) -> str:
    return f"transform({col}, x -> named_struct('field', x.field, 'message', x.message))"


B_NO_NUMERIC_ERRORS = (f"array(named_struct('field', {_q(MSG_B_NO_NUMERIC[0])}, "
                       f"'message', {_q(MSG_B_NO_NUMERIC[1])}))")
