"""DuckDB SQL for each registered query, written from the rules, not from Spark.

Each statement recomputes the query's result straight from the driver tables
(``events``, ``orders``, ``customer``, ``documents``, ...). Payload texts are
rebuilt with the same integer/string formatting rules as
:mod:`assaykit.sources.synth`, so hashes can be compared; gate outcomes are
derived from the rules that shaped each payload, not by re-validating JSON.
"""

from __future__ import annotations

from assaykit.functions.pii import _pads
from assaykit.plans.catalog import SALT
from assaykit.schemas import BUCKETS_BATCH_SIZE, BUCKETS_HTTP_SECONDS
from assaykit.operators.aggregates import bucket_label

_IPAD, _OPAD = _pads(SALT)
D = "::DOUBLE"


def hmac(x: str) -> str:
    return f"('sha256:' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({x})))))"


def uuid(x: str) -> str:
    h = f"sha256({x})"
    return f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), substr({h},17,4), substr({h},21,12))"


def dec2(c: str) -> str:
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def dec3(c: str) -> str:
    return f"(CAST({c} // 1000 AS VARCHAR) || '.' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0'))"


EV = f"""ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events)"""

KTEXT = "(CAST(k // 10 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR))"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
UID = "CAST(user_id AS VARCHAR)"
E = "CAST(event_id AS VARCHAR)"

_A_ASSESS = (f"'\"assessment\": {{' || CASE WHEN event_id % 7 = 0 THEN '' ELSE '\"date\": \"' || {ISO} || '\", ' END "
             f"|| '\"type\": \"' || event_type || '\", \"scores\": {{\"value\": ' || {dec3('cents')} || ', \"k\": ' "
             f"|| CASE WHEN event_id % 13 = 0 THEN '\"' || {KTEXT} || '\"' ELSE {KTEXT} END "
             f"|| '}}, \"notes\": \"note ' || {E} || '\"}}'")
_A_PATIENT = (f"'\"patient\": {{\"id\": ' || CASE WHEN event_id % 19 = 0 THEN {UID} ELSE '\"U' || {UID} || '\"' END "
              f"|| ', \"name\": \"Patient ' || {UID} || '\", \"dob\": \"1990-01-01\"}}'")
A_RAW = (f"CASE WHEN event_id % 23 = 0 THEN '{{\"patient\": {{\"id\": \"U' || {UID} || '\"' "
         f"WHEN event_id % 17 = 0 THEN '{{' || {_A_ASSESS} || '}}' "
         f"ELSE '{{' || {_A_PATIENT} || ', ' || {_A_ASSESS} || '}}' END")

_B_HEAD = f"'{{\"patient_id\": \"U' || {UID} || '\"'"
_B_NAME = f"', \"patient_name\": \"Patient ' || {UID} || '\"'"
_B_TYPE = "', \"assessment_type\": \"' || event_type || '\"'"
B_RAW = (f"CASE WHEN event_id % 23 = 0 THEN {_B_HEAD} || ', \"score_value\": ' "
         f"WHEN event_id % 17 = 0 THEN {_B_HEAD} || {_B_NAME} || {_B_TYPE} || '}}' "
         f"WHEN event_id % 29 = 0 THEN {_B_HEAD} || {_B_TYPE} || ', \"score_value\": \"' || {dec2('cents')} || '\"}}' "
         f"WHEN event_id % 31 = 0 THEN {_B_HEAD} || {_B_TYPE} || ', \"score_\": ' || CAST(k AS VARCHAR) "
         f"|| ', \"score_value\": ' || {dec2('cents')} || '}}' "
         f"ELSE {_B_HEAD} || {_B_NAME} || {_B_TYPE} || ', \"score_value\": ' || {dec2('cents')} "
         f"|| ', \"score_k\": ' || CAST(k AS VARCHAR) || ', \"notes\": \"note ' || {E} || '\"}}' END")

C_LINE = (f"'U' || {UID} || ',' || day || ',metric_' || CAST(event_id % 3 AS VARCHAR) || ',' || "
          f"CASE WHEN event_id % 37 = 0 THEN 'n/a' ELSE {dec3('cents')} END || ',' || event_type")

SV_A = f"((cents{D} / 1000.0{D}) * 10.0{D})"
SV_B = f"(cents{D} / 100.0{D})"

# A and B payload outcomes (one row per event)
PA = f"""pa AS (
  SELECT 'a-' || {E} AS payload_id, event_id, ts, user_id, event_type, cents, k,
         ts + INTERVAL 1 HOUR AS received_at,
         CASE WHEN event_id % 43 = 0 THEN 'provider_z' ELSE 'provider_a' END AS provider,
         {A_RAW} AS raw,
         {SV_A} AS sv, ((k{D} / 10.0{D}) * 10.0{D}) AS sk,
         CASE WHEN event_id % 43 = 0 THEN 'provider'
              WHEN event_id % 23 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 THEN 'pre'
              WHEN event_id % 13 = 0 THEN 'deep'
              WHEN {SV_A} > 100.0 THEN 'post' ELSE 'ok' END AS stage
  FROM ev)"""

PB = f"""pb AS (
  SELECT 'b-' || {E} AS payload_id, event_id, ts, user_id, event_type, cents, k,
         ts AS received_at, 'provider_b' AS provider, {B_RAW} AS raw, {SV_B} AS sv,
         CASE WHEN event_id % 23 = 0 OR event_id % 17 = 0 THEN 'pre'
              WHEN event_id % 29 = 0 THEN 'deep'
              WHEN event_id % 31 = 0 OR {SV_B} > 100.0 THEN 'post' ELSE 'ok' END AS stage
  FROM ev)"""

CL = f"""cl AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS day, event_id // 4096 AS chunk,
         'c-' || {UID} || '-' || strftime(ts, '%Y-%m-%d') || '-' || CAST(event_id // 4096 AS VARCHAR) AS payload_id
  FROM ev)"""

PC = f"""pc0 AS (
  SELECT payload_id, any_value(user_id) AS user_id, any_value(day) AS day, min(event_id) AS first_id,
         max(ts) AS received_at, bool_or(event_id % 37 = 0) AS bad_value,
         sum(CASE WHEN {SV_A} > 100.0 THEN 1 ELSE 0 END) AS n_over,
         count(*) AS n_lines, count(DISTINCT event_type) AS n_types,
         CASE WHEN min(event_id) % 41 = 0 THEN 'patient_id,assessment_date,metric_name,metric_value'
              ELSE 'patient_id,assessment_date,metric_name,metric_value,category' END
           || chr(10) || string_agg({C_LINE}, chr(10) ORDER BY event_id) AS raw
  FROM cl GROUP BY payload_id),
pc AS (
  SELECT *, 'provider_c' AS provider,
         CASE WHEN first_id % 41 = 0 THEN 'pre' WHEN bad_value THEN 'deep'
              WHEN n_over > 0 THEN 'post' ELSE 'ok' END AS stage
  FROM pc0)"""

KIND = ("CASE stage WHEN 'provider' THEN 'unknown_provider' WHEN 'pre' THEN 'validation' "
        "WHEN 'deep' THEN CASE WHEN provider = 'provider_b' THEN 'validation' ELSE 'parse' END "
        "WHEN 'normalize' THEN 'parse' WHEN 'post' THEN 'validation' END")

# the gate over all three formats: one row per payload
GATE = f"""{EV}, {PA}, {PB}, {CL}, {PC},
g AS (
  SELECT payload_id, provider, stage, raw, received_at,
         CASE WHEN stage = 'pre' THEN 1 ELSE 0 END AS n_pre,
         CASE WHEN stage = 'post' THEN CAST(sv > 100.0 AS INTEGER) + CAST(sk > 100.0 AS INTEGER) ELSE 0 END AS n_post,
         CASE WHEN stage = 'ok' THEN 1 ELSE 0 END AS n_assessments,
         CASE WHEN stage = 'ok' THEN 2 ELSE 0 END AS score_count, 'nested_json' AS source_format
  FROM pa
  UNION ALL
  SELECT payload_id, provider, stage, raw, received_at,
         CASE WHEN stage = 'pre' THEN 1 ELSE 0 END,
         CASE WHEN stage = 'post' THEN CAST(event_id % 31 = 0 AS INTEGER) + CAST(sv > 100.0 AS INTEGER) ELSE 0 END,
         CASE WHEN stage = 'ok' THEN 1 ELSE 0 END,
         CASE WHEN stage = 'ok' THEN 2 ELSE 0 END, 'flat_kv'
  FROM pb
  UNION ALL
  SELECT payload_id, provider, stage, raw, received_at,
         CASE WHEN stage = 'pre' THEN 1 ELSE 0 END,
         CASE WHEN stage = 'post' THEN n_over ELSE 0 END,
         CASE WHEN stage = 'ok' THEN n_types ELSE 0 END,
         CASE WHEN stage = 'ok' THEN n_lines ELSE 0 END, 'csv'
  FROM pc),
gk AS (SELECT *, {KIND} AS error_kind, sha256(raw) AS input_hash, strlen(raw) AS input_size_bytes FROM g)"""

# successful assessments with their scores, one row per score
SCORES = f"""{GATE},
sa AS (
  SELECT payload_id, 0 AS assessment_index, 'U' || {UID} AS pid, event_type AS assessment_type,
         CASE WHEN event_id % 7 = 0 THEN received_at ELSE ts END AS assessment_date, received_at AS ingested_at, 'provider_a' AS provider, 'nested_json' AS source_format,
         0 AS score_index, 'k' AS dimension, sk AS value, 2 AS payload_scores FROM pa WHERE stage = 'ok'
  UNION ALL
  SELECT payload_id, 0, 'U' || {UID}, event_type, CASE WHEN event_id % 7 = 0 THEN received_at ELSE ts END,
         received_at, 'provider_a', 'nested_json',
         1, 'value', sv, 2 FROM pa WHERE stage = 'ok'
  UNION ALL
  SELECT payload_id, 0, 'U' || {UID}, event_type, ts, ts, 'provider_b', 'flat_kv', 0, 'k', k{D}, 2
  FROM pb WHERE stage = 'ok'
  UNION ALL
  SELECT payload_id, 0, 'U' || {UID}, event_type, ts, ts, 'provider_b', 'flat_kv', 1, 'value', sv, 2
  FROM pb WHERE stage = 'ok'
  UNION ALL
  SELECT cl.payload_id,
         CAST(dense_rank() OVER (PARTITION BY cl.payload_id ORDER BY cl.event_type) - 1 AS INTEGER),
         'U' || CAST(cl.user_id AS VARCHAR), cl.event_type, CAST(cl.day AS TIMESTAMP), pc.received_at,
         'provider_c', 'csv',
         CAST(row_number() OVER (PARTITION BY cl.payload_id, cl.event_type ORDER BY cl.event_id) - 1 AS INTEGER),
         'metric_' || CAST(cl.event_id % 3 AS VARCHAR), {SV_A.replace('cents', 'cl.cents')}, pc.n_lines
  FROM cl JOIN pc ON cl.payload_id = pc.payload_id WHERE pc.stage = 'ok'),
sx AS (SELECT *, {uuid("payload_id || '#' || CAST(assessment_index AS VARCHAR)")} AS assessment_id FROM sa),
asm AS (
  SELECT assessment_id, any_value(payload_id) AS payload_id, any_value(assessment_index) AS assessment_index,
         any_value(pid) AS pid, any_value(assessment_type) AS assessment_type,
         any_value(assessment_date) AS assessment_date, any_value(ingested_at) AS ingested_at,
         any_value(provider) AS provider, any_value(source_format) AS source_format,
         count(*) AS n_scores, any_value(payload_scores) AS payload_scores
  FROM sx GROUP BY assessment_id),
asx AS (SELECT asm.*, gk.input_hash, gk.input_size_bytes FROM asm JOIN gk USING (payload_id))"""

ORACLES: dict[str, str] = {}


def _o(name: str, sql: str):
    ORACLES[name] = sql


_o("v_gate", f"""WITH {GATE}
SELECT payload_id, provider, stage, {KIND} AS error_kind, n_pre, n_post, n_assessments, score_count FROM g""")

_o("read_payloads", f"""WITH {GATE}
SELECT payload_id, provider, input_hash, input_size_bytes FROM gk""")

_BATCH = f"""{EV}, bi AS (
  SELECT 's-' || {UID} || '-' || strftime(ts, '%Y-%m-%d') || '-' || CAST(event_id // 4096 AS VARCHAR) AS submission_id,
         event_id,
         CASE WHEN event_id % 11 = 0 THEN 'unknown_provider' ELSE 'provider_b' END AS provider,
         '{{"assessment_type":"' || event_type || '","patient_id":"U' || {UID} || '","score_k":' || CAST(k AS VARCHAR)
           || ',"score_value":' || CAST(cents // 100 AS VARCHAR) || '}}' AS data,
         cents // 100 AS score_value
  FROM ev)"""

_o("explode_batch", f"""WITH {_BATCH}
SELECT submission_id,
       CAST(row_number() OVER (PARTITION BY submission_id ORDER BY event_id) - 1 AS INTEGER) AS item_index,
       provider, sha256(data) AS item_hash, strlen(data) AS item_bytes FROM bi""")

_o("batch_outcome", f"""WITH {_BATCH},
o AS (SELECT submission_id, provider = 'provider_b' AND score_value <= 100 AS ok FROM bi)
SELECT submission_id, count(*) AS n_items, count(*) FILTER (WHERE ok) AS n_succeeded,
       count(*) FILTER (WHERE NOT ok) AS n_failed, count(*) FILTER (WHERE ok) AS n_assessments,
       CASE WHEN count(*) FILTER (WHERE NOT ok) = 0 THEN 200
            WHEN count(*) FILTER (WHERE ok) = 0 THEN 400 ELSE 207 END AS status
FROM o GROUP BY submission_id""")

_o("scan_nested_json", f"""WITH {EV}, {PA}
SELECT payload_id, 'U' || {UID} AS patient_id, event_type AS assessment_type,
       CASE WHEN event_id % 7 = 0 THEN received_at ELSE ts END AS assessment_date,
       2 AS n_scores
FROM pa WHERE stage IN ('normalize', 'post', 'ok')""")

_o("scan_flat_kv", f"""WITH {EV}, {PB}
SELECT payload_id, 'k' AS dimension, round(k{D}, 6) AS value FROM pb
WHERE stage <> 'pre' AND event_id % 29 <> 0 AND event_id % 31 <> 0
UNION ALL
SELECT payload_id, '' AS dimension, round(k{D}, 6) FROM pb WHERE stage <> 'pre' AND event_id % 29 <> 0 AND event_id % 31 = 0
UNION ALL
SELECT payload_id, 'value', round(sv, 6) FROM pb WHERE stage <> 'pre' AND event_id % 29 <> 0""")

_o("scan_csv", f"""WITH {EV}, {CL}
SELECT payload_id,
       CAST(row_number() OVER (PARTITION BY payload_id ORDER BY event_id) - 1 AS INTEGER) AS line_no,
       'U' || {UID} AS patient_id, day AS assessment_date, 'metric_' || CAST(event_id % 3 AS VARCHAR) AS metric_name,
       CASE WHEN event_id % 37 = 0 THEN 'n/a' ELSE {dec3('cents')} END AS metric_value,
       CASE WHEN min(event_id) OVER (PARTITION BY payload_id) % 41 = 0 THEN NULL ELSE event_type END AS category
FROM cl""")

_o("v_pre_a", f"""WITH {EV}, {PA}
SELECT payload_id, 0 AS violation_index,
       CASE WHEN event_id % 23 = 0 THEN 'body' WHEN event_id % 17 = 0 THEN 'patient' ELSE 'patient.id' END AS field,
       CASE WHEN event_id % 23 = 0 THEN 'valid JSON' WHEN event_id % 17 = 0 THEN 'object' ELSE 'string' END AS expected,
       CASE WHEN event_id % 23 = 0 THEN 'invalid JSON' WHEN event_id % 17 = 0 THEN 'missing' ELSE {UID} END AS actual,
       CASE WHEN event_id % 23 = 0 THEN 'JSON parse error: invalid JSON'
            WHEN event_id % 17 = 0 THEN 'provider_a requires ''patient'' object'
            ELSE 'patient.id is required and must be a string' END AS message
FROM pa WHERE stage = 'pre'""")

_o("v_pre_b", f"""WITH {EV}, {PB}
SELECT payload_id, 0 AS violation_index,
       CASE WHEN event_id % 23 = 0 THEN 'body' ELSE 'score_*' END AS field,
       CASE WHEN event_id % 23 = 0 THEN 'valid JSON' ELSE 'at least one score_* key' END AS expected,
       CASE WHEN event_id % 23 = 0 THEN 'invalid JSON' ELSE 'none found' END AS actual,
       CASE WHEN event_id % 23 = 0 THEN 'JSON parse error: invalid JSON'
            ELSE 'provider_b requires at least one score_* field' END AS message
FROM pb WHERE stage = 'pre'""")

_o("v_pre_c", f"""WITH {EV}, {CL}, {PC}
SELECT payload_id, 0 AS violation_index, 'category' AS field, 'column present in CSV header' AS expected,
       'missing' AS actual, 'CSV is missing required column: category' AS message
FROM pc WHERE stage = 'pre'""")

_o("v_deep", f"""WITH {GATE}
SELECT payload_id, provider, {KIND} AS error_kind FROM g WHERE stage = 'deep'""")

_o("v_post", f"""WITH {EV}, {PA}, {PB}, {CL}, {PC},
c_rows AS (
  SELECT cl.payload_id, cl.event_type, cl.event_id, {SV_A.replace('cents', 'cl.cents')} AS sv,
         row_number() OVER (PARTITION BY cl.payload_id, cl.event_type ORDER BY cl.event_id) - 1 AS score_index
  FROM cl JOIN pc ON cl.payload_id = pc.payload_id WHERE pc.stage = 'post'),
c_over AS (SELECT * FROM c_rows WHERE sv > 100.0)
SELECT payload_id, provider, 0 AS violation_index, 'scores[1].value' AS field, '0.0-100.0' AS expected
FROM pa WHERE stage = 'post'
UNION ALL
SELECT payload_id, provider, 0, 'scores[0].dimension', 'non-empty string' FROM pb
WHERE stage = 'post' AND event_id % 31 = 0
UNION ALL
SELECT payload_id, provider, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END, 'scores[1].value', '0.0-100.0'
FROM pb WHERE stage = 'post' AND sv > 100.0
UNION ALL
SELECT payload_id, 'provider_c',
       CAST(row_number() OVER (PARTITION BY payload_id ORDER BY event_type, event_id) - 1 AS INTEGER),
       'scores[' || CAST(score_index AS VARCHAR) || '].value', '0.0-100.0'
FROM c_over""")

_o("v_output", f"""WITH {GATE}
SELECT provider, count(*) AS n_checked, count(*) FILTER (stage = 'post') AS n_rejected, CAST(sum(n_post) AS BIGINT) AS n_errors
FROM g WHERE stage IN ('ok', 'post') GROUP BY provider""")

_o("v_empty", """SELECT 'b-' || CAST(event_id AS VARCHAR) AS payload_id,
  ['provider_a', 'provider_b', 'provider_c'][event_id % 3 + 1] AS provider, 'validation' AS error_kind, 'body' AS field,
  'non-empty input' AS expected, 'empty' AS actual, 'input body is empty' AS message
FROM events WHERE event_id % 10 = 0""")

_o("classify_error", f"""WITH {GATE}
SELECT provider, {KIND} AS error_kind, count(*) AS n FROM g WHERE stage <> 'ok' GROUP BY ALL""")

_o("violation_to_error", f"""WITH {GATE},
pre AS (SELECT * FROM g WHERE stage = 'pre')
SELECT pre.payload_id, 0 AS error_index,
       CASE WHEN pre.provider = 'provider_c' THEN 'category'
            WHEN pa.event_id % 23 = 0 OR pb.event_id % 23 = 0 THEN 'body'
            WHEN pa.event_id % 17 = 0 THEN 'patient'
            WHEN pb.event_id % 17 = 0 THEN 'score_*' ELSE 'patient.id' END AS field,
       CASE WHEN pre.provider = 'provider_c' THEN 'CSV is missing required column: category'
            WHEN pa.event_id % 23 = 0 OR pb.event_id % 23 = 0 THEN 'JSON parse error: invalid JSON'
            WHEN pa.event_id % 17 = 0 THEN 'provider_a requires ''patient'' object'
            WHEN pb.event_id % 17 = 0 THEN 'provider_b requires at least one score_* field'
            ELSE 'patient.id is required and must be a string' END AS message
FROM pre LEFT JOIN pa ON pre.payload_id = pa.payload_id LEFT JOIN pb ON pre.payload_id = pb.payload_id""")


def _norm(provider: str) -> str:
    return f"""WITH {SCORES}
SELECT assessment_id, {hmac('pid')} AS patient_id, assessment_type, assessment_date, score_index, dimension,
       round(value, 6) AS value, '0-100' AS scale
FROM sx WHERE provider = '{provider}'"""


_o("norm_a", _norm("provider_a"))
_o("norm_b", _norm("provider_b"))
_o("norm_c", _norm("provider_c"))

_o("flatten_scores", f"""WITH {SCORES}
SELECT assessment_id, provider AS source_provider, dimension, round(value, 6) AS value FROM sx""")

_o("score_rescale", f"""SELECT event_id,
  round(0.0{D} + (least(greatest(value, 0.0{D}), 250.0{D}) - 0.0{D}) / 250.0{D} * 100.0{D}, 6) AS score
FROM events""")

_o("norm_declarative", f"""WITH {EV}
SELECT 'd-' || {E} AS payload_id, 'U' || {UID} AS patient_id, event_type AS assessment_type, 'k' AS dimension,
       round(0.0{D} + (least(greatest(k{D}, 0.0{D}), 100.0{D}) - 0.0{D}) / 100.0{D} * 100.0{D}, 6) AS value FROM ev
UNION ALL
SELECT 'd-' || {E}, 'U' || {UID}, event_type, 'v',
       round(0.0{D} + (least(greatest(CAST(floor(round(value * 100) / 100) AS BIGINT){D}, 0.0{D}), 100.0{D}) - 0.0{D})
             / 100.0{D} * 100.0{D}, 6) FROM ev""")

_o("norm_registered", f"""WITH {EV},
x AS (SELECT *, CAST(floor(round(value * 100) / 100) AS BIGINT) AS v FROM ev)
SELECT 'provider_d' AS provider, 'declared_json' AS key, dimension, count(*) AS n,
       round(sum(least(greatest(score, 0.0{D}), 100.0{D})), 3) AS total
FROM (SELECT unnest(['k', 'v']) AS dimension, unnest([k{D}, v{D}]) AS score FROM x WHERE event_id % 23 <> 0) GROUP BY dimension
UNION ALL SELECT 'provider_e', 'lines', 'v', count(*), round(sum(v{D}), 3) FROM x WHERE event_id % 29 <> 0 AND v <= 100
UNION ALL SELECT 'provider_d', 'validation', NULL, count(DISTINCT (user_id, event_type, k, v)), NULL FROM x WHERE event_id % 23 = 0
UNION ALL SELECT 'provider_e', 'parse', NULL, count(DISTINCT (user_id, event_type)), NULL FROM x WHERE event_id % 29 = 0
UNION ALL SELECT 'provider_e', 'validation', NULL, count(DISTINCT (user_id, event_type, v)), NULL
FROM x WHERE event_id % 29 <> 0 AND v > 100""")

_o("stamp_metadata", f"""WITH {SCORES}
SELECT assessment_id, provider AS source_provider, source_format, '1.0' AS version, ingested_at FROM asm""")

_o("default_date", f"""WITH {SCORES}
SELECT payload_id, assessment_date, assessment_date = ingested_at AS same_as_ingest FROM asm
WHERE provider = 'provider_a'""")

_o("assign_id", f"""WITH {SCORES}
SELECT payload_id, assessment_index, assessment_id FROM asm""")

_o("camel_json", f"""WITH {SCORES}
SELECT assessment_id, {hmac('pid')} AS patient_id, n_scores, source_format FROM asm""")

_o("build_envelope", f"""WITH {SCORES}
SELECT assessment_id, input_hash, CAST(payload_scores AS INTEGER) AS score_count, provider,
       'pending' AS status, 0 AS retries FROM asx""")

_F = f"""f AS (SELECT {uuid("'failed#' || input_hash || '#' || provider")} AS id, provider, error_kind, input_hash,
             false AS replayed, received_at AS created_at, payload_id, stage, n_pre, n_post
      FROM gk WHERE stage <> 'ok'),
vr AS (SELECT {uuid("'violation#' || CASE WHEN stage = 'pre' THEN 'pre_transform' ELSE 'post_transform' END || '#' || provider || '#' || input_hash")} AS id,
              CASE WHEN stage = 'pre' THEN 'pre_transform' ELSE 'post_transform' END AS boundary,
              provider, input_hash, CASE WHEN stage = 'pre' THEN n_pre ELSE n_post END AS n_violations,
              created_at, payload_id
       FROM f WHERE stage IN ('pre', 'post'))"""
_FAILED = f"{GATE},\n{_F}"

# what the store holds of the failures: one per input and provider, the first
_H = f"""{_F},
held AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY provider, input_hash ORDER BY created_at, id) = 1),
vheld AS (SELECT * FROM vr QUALIFY row_number() OVER (PARTITION BY boundary, provider, input_hash ORDER BY created_at, id) = 1)"""

_o("api_view_failed", f"""WITH {_FAILED}
SELECT id, provider, error_kind, input_hash, replayed FROM f""")

_o("api_view_violations", f"""WITH {_FAILED}
SELECT id, boundary, provider, input_hash, n_violations FROM vr""")

_o("agg_score_count", f"""WITH {SCORES}
SELECT payload_id, assessment_id, n_scores AS scores_in_assessment, payload_scores AS scores_in_payload FROM asm""")

_o("audit_hash", """SELECT doc_id, sha256(text) AS input_hash, strlen(text) AS input_size_bytes FROM documents""")

_o("audit_steps", f"""WITH {GATE}
SELECT payload_id,
  CASE stage WHEN 'provider' THEN ''
    WHEN 'pre' THEN 'validate_pre_transform'
    WHEN 'deep' THEN 'validate_pre_transform,validate_input'
    WHEN 'normalize' THEN 'validate_pre_transform,validate_input,normalize'
    WHEN 'post' THEN 'validate_pre_transform,validate_input,normalize,validate_post_transform'
    ELSE 'validate_pre_transform,validate_input,normalize,validate_post_transform,validate_output,pii_scrub' END AS steps,
  CASE stage WHEN 'provider' THEN 0 WHEN 'pre' THEN 1 WHEN 'deep' THEN 2 WHEN 'normalize' THEN 3
    WHEN 'post' THEN 4 ELSE 6 END AS n_steps
FROM g""")

_o("audit_row", f"""WITH {SCORES}
SELECT {uuid("'audit#' || assessment_id")} AS id, assessment_id, provider, source_format, input_hash,
       CAST(input_size_bytes AS INTEGER) AS input_size_bytes, CAST(payload_scores AS INTEGER) AS score_count FROM asx""")

_o("pii_hmac", f"""SELECT c_custkey, {hmac('c_name')} AS name_hash FROM customer""")
_o("pii_redact", """SELECT c_custkey, '[REDACTED]' AS name_redacted FROM customer""")
_o("pii_store_patient", f"""SELECT c_custkey, {hmac('c_name')} AS stored_strict, '[REDACTED]' AS stored_redact,
  c_name AS stored_internal FROM customer""")
_o("pii_store_raw", f"""SELECT doc_id, {hmac('text')} AS stored_strict, sha256(text) AS stored_internal_sha FROM documents""")
_o("pii_external_view", f"""SELECT c_custkey, {hmac('c_name')} AS external_from_plain,
  {hmac('c_name')} AS external_from_hash FROM customer""")

_o("pii_field_rules", f"""WITH {EV}
SELECT 'b-' || {E} AS payload_id,
  CASE WHEN event_id % 23 = 0 OR (event_id % 17 <> 0 AND (event_id % 29 = 0 OR event_id % 31 = 0)) THEN NULL
       ELSE {hmac("'Patient ' || CAST(user_id AS VARCHAR)")} END AS patient_name,
  CASE WHEN event_id % 23 = 0 OR event_id % 17 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0 THEN NULL
       ELSE '[REDACTED]' END AS notes,
  false AS leaked
FROM ev""")

_o("pii_leak_scan", f"""WITH {SCORES}
SELECT provider AS source_provider, count(*) AS n_rows, 0 AS n_leaks FROM asm GROUP BY provider""")

_o("agg_failed_backlog", f"""WITH {_FAILED}
SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(error_kind) = 0 THEN 'error_kind'
            ELSE 'total' END AS grouping,
       CASE WHEN grouping(provider) = 0 THEN provider WHEN grouping(error_kind) = 0 THEN error_kind END AS key,
       count(*) AS n
FROM f GROUP BY GROUPING SETS ((), (provider), (error_kind))""")

_o("agg_violations_recent", f"""WITH {_FAILED},
r AS (SELECT * FROM vr WHERE created_at >= (SELECT max(created_at) FROM vr) - INTERVAL 1 HOUR)
SELECT CASE WHEN grouping(boundary) = 0 THEN 'boundary' WHEN grouping(provider) = 0 THEN 'provider'
            ELSE 'total' END AS grouping,
       CASE WHEN grouping(boundary) = 0 THEN boundary WHEN grouping(provider) = 0 THEN provider END AS key,
       count(*) AS n
FROM r GROUP BY GROUPING SETS ((), (boundary), (provider))""")

OB = """ob AS (SELECT o_orderkey AS id, o_orderkey AS assessment_id,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'flushed' ELSE 'failed' END AS status,
  CAST(o_orderkey % 12 AS INTEGER) AS retries, o_orderdate AS created_at FROM orders)"""

_o("agg_outbox_status", f"""WITH {OB}
SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed
FROM ob""")

_o("audit_verdict", f"""WITH {_FAILED}, {OB},
x AS (SELECT (SELECT count(*) FROM f) AS failed_unreplayed,
             (SELECT count(*) FROM vr WHERE created_at >= (SELECT max(created_at) FROM vr) - INTERVAL 1 HOUR)
               AS violations_recent,
             (SELECT count(*) FROM ob WHERE status = 'pending') AS pending,
             (SELECT count(*) FROM ob WHERE status = 'failed') AS failed)
SELECT failed_unreplayed, violations_recent, pending, failed,
  CASE WHEN failed_unreplayed >= 10 THEN 'critical' WHEN failed_unreplayed > 0 THEN 'warning' ELSE 'ok' END AS failed_check,
  CASE WHEN violations_recent > 0 THEN 'warning' ELSE 'ok' END AS violations_check,
  CASE WHEN failed > 0 THEN 'critical' WHEN pending >= 5 THEN 'warning' ELSE 'ok' END AS outbox_check,
  CASE WHEN failed_unreplayed >= 10 OR failed > 0 THEN 'critical'
       WHEN failed_unreplayed > 0 OR violations_recent > 0 OR pending >= 5 THEN 'warning' ELSE 'ok' END AS verdict,
  CASE WHEN failed_unreplayed >= 10 OR failed > 0 THEN 1 ELSE 0 END AS exit_code
FROM x""")

_o("agg_violations_by_boundary", f"""WITH {_FAILED}
SELECT payload_id, boundary, n_violations FROM vr""")

_o("agg_counters", f"""WITH {GATE}
SELECT provider, CASE WHEN stage = 'ok' THEN 'success' ELSE 'error' END AS status, count(*) AS n
FROM g GROUP BY ALL""")

_BOUNDS = ", ".join(f"({i}, '{bucket_label(b)}', {float(b)!r}{D})" for i, b in enumerate(BUCKETS_HTTP_SECONDS))
_BOUNDS += f", ({len(BUCKETS_HTTP_SECONDS)}, '+Inf', 'inf'{D})"
HB = f"hb(bucket_index, le, bound) AS (VALUES {_BOUNDS})"
LAT = f"lat AS (SELECT *, value / 100.0{D} AS latency_s FROM events)"

_o("agg_histogram", f"""WITH {HB}, {LAT}
SELECT event_type, CAST(bucket_index AS INTEGER) AS bucket_index, le,
       count(*) FILTER (WHERE latency_s <= bound) AS bucket_count
FROM lat CROSS JOIN hb GROUP BY event_type, bucket_index, le""")


def _quantile_sql(group_cols: str, source: str, qs=(0.5, 0.95, 0.99)) -> str:
    """Histogram quantiles in SQL: cumulative bucket counts, first bucket at the rank, interpolate."""
    last_finite = float(BUCKETS_HTTP_SECONDS[-1])
    n = len(BUCKETS_HTTP_SECONDS)
    parts = []
    for q in qs:
        name = f"p{int(q * 100)}"
        parts.append(f"""{name} AS (
  SELECT {group_cols}, CASE WHEN total = 0 THEN NULL WHEN bucket_index = {n} THEN {last_finite}{D}
         ELSE prev_bound + (bound - prev_bound) * ({q}{D} * total - prev_cnt) / (cnt - prev_cnt) END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY {group_cols} ORDER BY bucket_index) AS rn
        FROM hc WHERE cnt >= {q}{D} * total) WHERE rn = 1)""")
    return f"""h AS (
  SELECT {group_cols}, bucket_index, bound, count(*) FILTER (WHERE latency_s <= bound) AS cnt
  FROM {source} CROSS JOIN hb GROUP BY {group_cols}, bucket_index, bound),
hc AS (
  SELECT *, coalesce(lag(cnt) OVER w, 0) AS prev_cnt, coalesce(lag(bound) OVER w, 0.0{D}) AS prev_bound,
         max(cnt) OVER (PARTITION BY {group_cols}) AS total
  FROM h WINDOW w AS (PARTITION BY {group_cols} ORDER BY bucket_index)),
""" + ",\n".join(parts)


_o("agg_histogram_quantile", f"""WITH {HB}, {LAT}, {_quantile_sql('event_type', 'lat')}
SELECT t.event_type, t.n, round(p50.v, 6) AS p50, round(p95.v, 6) AS p95, round(p99.v, 6) AS p99
FROM (SELECT event_type, count(*) AS n FROM lat GROUP BY event_type) t
JOIN p50 USING (event_type) JOIN p95 USING (event_type) JOIN p99 USING (event_type)""")

REDELIVERED = """rd AS (
  SELECT event_id, ts, user_id, event_type FROM events
  UNION ALL SELECT event_id, ts + INTERVAL 5 MINUTE, user_id, event_type FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, ts + INTERVAL 11 MINUTE, user_id, event_type FROM events WHERE event_id % 5 = 0)"""

_o("agg_first_wins", f"""WITH {REDELIVERED}
SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM rd) WHERE rn = 1""")

_o("j_insert_absent", f"""WITH {EV},
stored AS (SELECT DISTINCT user_id, k FROM ev WHERE day(ts) < 16),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS rn
                       FROM ev WHERE day(ts) >= 16) WHERE rn = 1)
SELECT new.user_id, new.k, new.event_id, new.ts FROM new
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = new.user_id AND s.k = new.k)""")

_o("j_assessment_audit", f"""WITH {SCORES}
SELECT assessment_id, CAST(n_scores AS INTEGER) AS n_scores, provider, CAST(payload_scores AS INTEGER) AS score_count
FROM asm""")

_o("j_assessment_outbox", f"""WITH {SCORES}
SELECT assessment_id, provider AS source_provider, 'pending' AS status, 0 AS retries FROM asm""")

_o("j_orphans", """SELECT 'lineitem->orders' AS relation, count(*) AS n_orphans FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'orders->customer', count(*) FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")

_o("j_mark_flushed", f"""WITH {OB}
SELECT id, CASE WHEN status = 'pending' AND id % 3 <> 0 AND id % 4 < 2 THEN 'flushed' ELSE status END AS status,
       CASE WHEN status = 'pending' AND id % 3 <> 0 AND id % 4 < 2 THEN TIMESTAMP '2001-09-01 00:00:00' END AS flushed_at
FROM ob""")

_o("j_enabled", f"""WITH {GATE}
SELECT provider, count(*) AS n FROM g WHERE provider IN ('provider_a', 'provider_c') GROUP BY provider""")

_o("j_fanout", f"""WITH {SCORES}
SELECT assessment_id, s.sink_name, s.sink_type FROM asm
CROSS JOIN (VALUES ('http_main', 'http_json'), ('console', 'stdout')) s(sink_name, sink_type)""")

_o("q_audit_logs", f"""WITH {SCORES}
SELECT {uuid("'audit#' || assessment_id")} AS id, assessment_id, ingested_at AS created_at FROM asm
WHERE provider = 'provider_b'""")

_o("q_violations", f"""WITH {_FAILED}
SELECT id, provider, input_hash, created_at FROM vr WHERE boundary = 'post_transform'""")

_o("q_failed", f"""WITH {_FAILED}
SELECT id, input_hash, error_kind, created_at FROM f WHERE provider = 'provider_c' AND error_kind = 'parse'""")

_o("q_assessment_by_id", f"""WITH {SCORES}
SELECT assessment_id AS id, assessment_type, CAST(n_scores AS INTEGER) AS n_scores FROM asm
WHERE assessment_id = {uuid("'b-1#0'")}""")

_o("q_failed_by_id", f"""WITH {_FAILED}
SELECT id, provider, error_kind FROM f
WHERE payload_id = 'a-' || CAST((SELECT min(event_id) FROM events WHERE event_id % 23 = 0) AS VARCHAR)""")

_o("q_stale_outbox", f"""WITH {OB}
SELECT id, created_at, retries FROM ob
WHERE status = 'pending' AND created_at < (SELECT max(created_at) FROM ob) - INTERVAL 300 SECOND
ORDER BY created_at, id LIMIT 100""")


def _bucket(secs: int, offset: int = 0) -> str:
    return (f"make_timestamp(CAST(floor(epoch_us(ts) / {secs * 1_000_000}) * {secs * 1_000_000} "
            f"- {offset * 1_000_000} AS BIGINT))")


_o("ts_rate", f"""SELECT {_bucket(300)} AS window_start, event_type, round(count(*) / 300.0{D}, 6) AS rate
FROM events GROUP BY ALL""")

_o("ts_error_ratio", f"""SELECT '5m' AS window_len, {_bucket(300)} AS window_start,
       count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*){D}, 6) AS error_ratio
FROM events GROUP BY ALL
UNION ALL
SELECT '15m', window_start, count(*) FILTER (WHERE event_type = 'error'), count(*),
       round(count(*) FILTER (WHERE event_type = 'error') / count(*){D}, 6)
FROM (SELECT event_type, {_bucket(300)} - to_microseconds(CAST(o * 300000000 AS BIGINT)) AS window_start
      FROM events CROSS JOIN (VALUES (0), (1), (2)) t(o)) GROUP BY ALL""")

_o("ts_availability", f"""SELECT {_bucket(300)} AS window_start,
       round(1.0{D} - count(*) FILTER (WHERE event_type = 'error') / count(*){D}, 6) AS availability
FROM events GROUP BY ALL""")

_o("ts_error_budget", f"""WITH d AS (
  SELECT CAST(user_id % 10 AS INTEGER) AS instance, CAST(ts AS DATE) AS day,
         count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total
  FROM events GROUP BY ALL),
w AS (
  SELECT instance, day,
         sum(errors) OVER x AS errors_window, sum(total) OVER x AS total_window
  FROM d WINDOW x AS (PARTITION BY instance ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
SELECT instance, day, errors_window, total_window,
       round(1.0{D} - (errors_window{D} / total_window{D}) / (1.0{D} - 0.999{D}), 6) AS error_budget_remaining
FROM w""")

_WLAT = f"wl AS (SELECT {_bucket(300)} AS window_start, value / 100.0{D} AS latency_s FROM events)"

_o("ts_latency_quantile", f"""WITH {HB}, {_WLAT}, {_quantile_sql('window_start', 'wl')}
SELECT window_start, round(p50.v, 6) AS p50, round(p95.v, 6) AS p95, round(p99.v, 6) AS p99
FROM p50 JOIN p95 USING (window_start) JOIN p99 USING (window_start)""")

_SAMPLES = f"""{HB}, {_WLAT}, {_quantile_sql('window_start', 'wl', qs=(0.99,))},
samples AS (
  SELECT 'error_ratio_5m' AS metric, {_bucket(300)} AS window_start,
         count(*) FILTER (WHERE event_type = 'error') / count(*){D} AS value
  FROM events GROUP BY ALL
  UNION ALL SELECT 'error_ratio_15m', {_bucket(300)} - to_minutes(5 * back),
         count(*) FILTER (WHERE event_type = 'error') / count(*){D}
  FROM events, range(3) b(back) GROUP BY ALL
  UNION ALL SELECT 'latency_p99_5m', window_start, v FROM p99),
rules(rule, metric, threshold, for_seconds) AS (VALUES
  ('HighErrorRate', 'error_ratio_5m', 0.05{D}, 120), ('ElevatedErrorRate', 'error_ratio_15m', 0.01{D}, 900),
  ('HighLatency', 'latency_p99_5m', 1.0{D}, 300), ('HighFailureRate', 'failure_ratio_5m', 0.1{D}, 300),
  ('FailedRecordsPending', 'failed_records_pending', 10.0{D}, 600),
  ('FailedRecordsCritical', 'failed_records_pending', 50.0{D}, 300),
  ('SchemaViolations', 'schema_violations_recent', 5.0{D}, 600),
  ('ConsumerLag', 'consumer_pending', 100.0{D}, 300), ('ConsumerLagCritical', 'consumer_pending', 1000.0{D}, 120),
  ('OutboxBacklogGrowing', 'outbox_pending', 100.0{D}, 300),
  ('OutboxBacklogCritical', 'outbox_pending', 1000.0{D}, 120)),
ev AS (SELECT rule, window_start, value, for_seconds,
              CASE WHEN s.metric IS NOT NULL THEN coalesce(value > threshold, false) END AS firing
       FROM rules r LEFT JOIN samples s ON r.metric = s.metric)"""

_o("ts_alert_threshold", f"""WITH {_SAMPLES}
SELECT rule, window_start, round(value, 6) AS value, firing FROM ev""")

# a rule holds without a break while its samples, five minutes apart, all fire (every metric is sampled so)
_ISLANDS = """
fi AS (SELECT *, CASE WHEN lag(window_start) OVER w IS NULL
                       OR epoch(window_start) - epoch(lag(window_start) OVER w) > 300 THEN 1 ELSE 0 END AS brk
      FROM sampled WHERE firing WINDOW w AS (PARTITION BY rule ORDER BY window_start)),
is_ AS (SELECT *, sum(brk) OVER (PARTITION BY rule ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS island FROM fi),
so AS (SELECT rule, island, any_value(for_seconds) AS for_seconds, min(window_start) AS island_start,
             max(window_start) AS island_last, count(*) AS samples FROM is_ GROUP BY rule, island)
SELECT rule, island_start, island_last, samples,
       CAST(epoch(island_last) - epoch(island_start) AS BIGINT) AS duration_seconds,
       island_start + to_seconds(for_seconds) AS active_from
FROM so WHERE CAST(epoch(island_last) - epoch(island_start) AS BIGINT) >= for_seconds"""

_o("ts_alert_sustained", f"""WITH {_SAMPLES}, sampled AS (SELECT * FROM ev),{_ISLANDS}""")

_o("ts_alert_backlog", f"""WITH {SCORES}, {_H},
iv(metric, a, b) AS (
  SELECT 'failed_records_pending', created_at, CAST(NULL AS TIMESTAMP) FROM held
  UNION ALL SELECT 'schema_violations_recent', created_at, created_at + INTERVAL 1 HOUR + INTERVAL 1 MICROSECOND FROM vheld
  UNION ALL SELECT 'outbox_pending', ingested_at, NULL FROM asm),
ch AS (
  SELECT metric, CAST(ceil(epoch_us(a) / 300000000) AS BIGINT) AS k, 1 AS d FROM iv
  UNION ALL SELECT metric, CAST(ceil(epoch_us(b) / 300000000) AS BIGINT), -1 FROM iv WHERE b IS NOT NULL),
gr AS (SELECT metric, unnest(range(min(k), max(k) + 1)) AS k, 0 AS d FROM ch GROUP BY metric),
al AS (SELECT metric, k, sum(d) AS d FROM (FROM ch UNION ALL FROM gr) GROUP BY metric, k),
samples AS (
  SELECT metric, make_timestamp(k * 300000000) AS window_start,
         CAST(sum(d) OVER (PARTITION BY metric ORDER BY k ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM al
  UNION ALL SELECT 'failure_ratio_5m', make_timestamp(epoch_us(received_at) // 300000000 * 300000000),
         count(*) FILTER (stage <> 'ok') / count(*){D} FROM gk GROUP BY ALL),
rules(rule, metric, threshold, for_seconds) AS (VALUES
  ('HighFailureRate', 'failure_ratio_5m', 0.1{D}, 300), ('FailedRecordsPending', 'failed_records_pending', 10.0{D}, 600),
  ('FailedRecordsCritical', 'failed_records_pending', 50.0{D}, 300),
  ('SchemaViolations', 'schema_violations_recent', 5.0{D}, 600),
  ('OutboxBacklogGrowing', 'outbox_pending', 100.0{D}, 300), ('OutboxBacklogCritical', 'outbox_pending', 1000.0{D}, 120)),
sampled AS (SELECT *, value > threshold AS firing FROM rules JOIN samples USING (metric)),{_ISLANDS}""")

_o("ts_gauge_snapshot", """WITH sh AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
iv AS (
  SELECT o_orderpriority AS priority, o_orderdate AS a, CASE WHEN o_orderstatus = 'F' THEN shipped END AS b
  FROM orders LEFT JOIN sh ON l_orderkey = o_orderkey),
ch AS (
  SELECT priority, CAST(ceil(epoch(CAST(a AS TIMESTAMP)) / 86400) AS BIGINT) AS k, 1 AS d FROM iv WHERE b IS NULL OR b > a
  UNION ALL SELECT priority, CAST(ceil(epoch(CAST(b AS TIMESTAMP)) / 86400) AS BIGINT), -1 FROM iv WHERE b > a),
gr AS (SELECT priority, unnest(range(min(k), max(k) + 1)) AS k, 0 AS d FROM ch GROUP BY priority),
al AS (SELECT priority, k, sum(d) AS d FROM (FROM ch UNION ALL FROM gr) GROUP BY priority, k)
SELECT priority, make_timestamp(k * 86400000000) AS at,
       CAST(sum(d) OVER (PARTITION BY priority ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM al""")

_FANOUT = """fo AS (
  SELECT o_orderkey AS assessment_id, s.sink_name,
         CASE WHEN s.sink_name = 'http_main' THEN o_orderkey % 4 <> 3 ELSE o_orderkey % 5 <> 4 END AS ok
  FROM orders CROSS JOIN (VALUES ('http_main'), ('console')) s(sink_name)),
dr AS (
  SELECT assessment_id, count(*) AS sinks, count(*) FILTER (WHERE ok) AS succeeded,
         count(*) FILTER (WHERE NOT ok) AS failed
  FROM fo GROUP BY assessment_id),
drx AS (SELECT *, CASE WHEN sinks = 0 THEN 'no_sinks' WHEN failed = 0 THEN 'all_succeeded'
                       WHEN succeeded = 0 THEN 'all_failed' ELSE 'partial_failure' END AS outcome FROM dr)"""

_o("st_delivery_result", f"""WITH {_FANOUT}
SELECT assessment_id, sinks, succeeded, failed, outcome FROM drx""")

_o("st_outbox_state", f"""WITH {OB}, {_FANOUT}
SELECT id,
  CASE WHEN status <> 'pending' THEN status WHEN outcome IN ('all_succeeded', 'no_sinks') THEN 'flushed'
       WHEN retries + 1 >= 10 THEN 'failed' ELSE 'pending' END AS status,
  CAST(CASE WHEN status = 'pending' AND outcome NOT IN ('all_succeeded', 'no_sinks') THEN retries + 1
            ELSE retries END AS INTEGER) AS retries,
  CASE WHEN status = 'pending' AND outcome IN ('all_succeeded', 'no_sinks') THEN TIMESTAMP '2001-09-01 00:00:00'
       END AS flushed_at
FROM ob JOIN drx USING (assessment_id)""")

_o("st_backoff", """SELECT o_orderkey, CAST(a AS INTEGER) AS attempt,
  CAST(least(100 * pow(2, a - 1), 5000) AS BIGINT) AS base_ms, true AS in_range
FROM orders CROSS JOIN range(1, 6) r(a)""")

_TRANSIENT = " OR ".join(f"contains(lower(text), '{p}')" for p in [
    "connection refused", "connection reset", "broken pipe", "timed out", "timeout",
    "could not serialize access", "too many connections", "pool timed out"])
_o("st_transient", f"""SELECT conv_id, turn, coalesce({_TRANSIENT}, false) AS transient FROM conversations""")

_o("st_redelivery_limit", """WITH n AS (SELECT event_id % 8 + 1 AS n FROM events)
SELECT true AS delivered, sum(least(n, 5)) AS n FROM n
UNION ALL SELECT false, sum(greatest(n - 5, 0)) FROM n HAVING sum(greatest(n - 5, 0)) > 0""")

_o("st_expire", """SELECT count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS kept_7d,
  count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY) AS kept_30d,
  count(*) AS total FROM events""")

_o("st_triage_envelope", f"""WITH {SCORES}
SELECT 'env-' || assessment_id AS msg_id, 'envelope' AS kind, assessment_id FROM asm
UNION ALL SELECT 'leg-' || assessment_id, 'legacy', assessment_id FROM asm
UNION ALL SELECT 'poi-' || payload_id, 'poison', NULL FROM pb""")

_o("st_disposition", """WITH x AS (
  SELECT event_id,
    CASE WHEN event_id % 10 = 0 THEN 'poison' WHEN event_id % 3 = 0 THEN 'legacy' ELSE 'envelope' END AS kind,
    event_id % 7 <> 0 AS db_ok, event_id % 4 <> 0 AS sink_ok, event_id % 6 + 1 >= 5 AS over FROM events),
y AS (SELECT *, CASE WHEN kind = 'poison' THEN 'quarantined'
    WHEN NOT db_ok AND over THEN 'quarantined'
    WHEN NOT db_ok THEN 'retry'
    WHEN kind = 'legacy' AND NOT sink_ok AND over THEN 'quarantined'
    WHEN kind = 'legacy' AND NOT sink_ok THEN 'retry' ELSE 'accepted' END AS action FROM x)
SELECT event_id, kind, action,
  CAST(CASE WHEN action <> 'retry' THEN NULL WHEN NOT db_ok THEN 5 ELSE 10 END AS INTEGER) AS retry_after_secs FROM y""")

_o("purge", """WITH a AS (SELECT max(o_orderdate) - INTERVAL 90 DAY AS cutoff FROM orders),
exp AS (SELECT o_orderkey FROM orders, a WHERE o_orderdate < cutoff)
SELECT 'orders' AS table_name, (SELECT count(*) FROM exp) AS removed,
       (SELECT count(*) FROM orders) - (SELECT count(*) FROM exp) AS kept
UNION ALL
SELECT 'lineitem', (SELECT count(*) FROM lineitem) - k.kept, k.kept
FROM (SELECT count(*) AS kept FROM lineitem, a WHERE l_shipdate >= cutoff
      AND l_orderkey NOT IN (SELECT o_orderkey FROM exp)) k""")


_o("sink_envelopes", f"""WITH {SCORES}
SELECT provider AS source_provider, count(*) AS n_assessments, count(*) AS n_pending FROM asm GROUP BY provider""")

_o("sink_errors", f"""WITH {_FAILED}
SELECT provider, error_kind, count(DISTINCT input_hash) AS n, 'failed_records' AS table_name FROM f GROUP BY ALL
UNION ALL
SELECT provider, boundary, count(DISTINCT input_hash), 'schema_violations' FROM vr GROUP BY ALL""")

_o("sink_dead_letter", """SELECT count(*) FILTER (WHERE o_orderkey % 5 BETWEEN 1 AND 3) AS succeeded,
  count(*) FILTER (WHERE NOT (o_orderkey % 5 BETWEEN 1 AND 3)) AS failed,
  count(*) FILTER (WHERE NOT (o_orderkey % 5 BETWEEN 1 AND 3)) AS dead_letters FROM orders""")

_REPLAY = f"""{GATE},
rf AS (
  SELECT * FROM (
    SELECT payload_id, provider, stage, n_assessments,
           row_number() OVER (PARTITION BY provider, input_hash ORDER BY received_at, payload_id) AS rn
    FROM gk WHERE stage <> 'ok' OR provider = 'provider_c') WHERE rn = 1),
ro AS (
  SELECT payload_id, provider,
    CASE WHEN provider IN ('provider_a', 'provider_z') AND CAST(substr(payload_id, 3) AS BIGINT) % 5 = 0
           THEN 'already_replayed'
         WHEN provider = 'provider_b' THEN 'replay_requires_resubmission'
         WHEN provider = 'provider_c' AND stage = 'ok' THEN 'replayed'
         ELSE 'error' END AS outcome,
    CASE WHEN provider = 'provider_c' AND stage = 'ok' THEN n_assessments ELSE 0 END AS n_assessments
  FROM rf)"""

_o("replay", f"""WITH {_REPLAY}
SELECT payload_id, provider, outcome, n_assessments FROM ro""")

_o("j_replay", f"""WITH {_REPLAY}
SELECT provider, outcome IN ('already_replayed', 'replayed') AS replayed, outcome = 'replayed' AS has_replayed_at,
       count(*) AS n FROM ro GROUP BY ALL""")

_o("st_dedup_window", f"""WITH RECURSIVE {REDELIVERED},
chain(event_id, ts) AS (
  SELECT event_id, min(ts) FROM rd GROUP BY event_id
  UNION ALL
  SELECT c.event_id, (SELECT min(r.ts) FROM rd r WHERE r.event_id = c.event_id AND r.ts >= c.ts + INTERVAL 600 SECOND)
  FROM chain c WHERE c.ts IS NOT NULL)
SELECT event_id, ts FROM chain WHERE ts IS NOT NULL""")

_o("stream_payloads", f"""WITH {SCORES}
SELECT coalesce(a.provider, f.provider) AS source_provider, a.n AS n_assessments, f.n AS n_failed
FROM (SELECT provider, count(*) AS n FROM asm GROUP BY provider) a
FULL JOIN (SELECT provider, count(DISTINCT input_hash) AS n FROM gk WHERE stage <> 'ok' GROUP BY provider) f
  ON a.provider = f.provider""")

_o("st_sweep", f"""WITH {SCORES},
top AS (SELECT assessment_id, ingested_at FROM asm ORDER BY ingested_at, assessment_id LIMIT 100)
SELECT assessment_id, CASE WHEN substr(assessment_id, 1, 1) < '8' THEN 'flushed' ELSE 'pending' END AS status,
       CAST(CASE WHEN substr(assessment_id, 1, 1) < '8' THEN 0 ELSE 1 END AS INTEGER) AS retries,
       substr(assessment_id, 1, 1) < '8' AS flushed
FROM top""")

_o("scan_assessments", f"""WITH {SCORES}
SELECT assessment_id, CAST(n_scores AS INTEGER) AS n_scores, provider AS source_provider FROM asm""")

_o("sink_json", f"""WITH {SCORES}
SELECT assessment_id, {hmac('pid')} AS patient_id, assessment_type, CAST(n_scores AS INTEGER) AS n_scores FROM asm""")

_o("stream_outbox", f"""WITH {SCORES},
r AS (SELECT substr(assessment_id, 1, 1) < '8' AS taken FROM asm)
SELECT 'assessments' AS table_name, provider AS key, count(*) AS n FROM asm GROUP BY provider
UNION ALL SELECT 'normalization_audit_log', 'all', count(*) FROM asm
UNION ALL SELECT 'outbox', CASE WHEN taken THEN 'flushed' ELSE 'pending' END, count(*) FROM r GROUP BY taken
UNION ALL SELECT 'legacy_deliveries', 'all', count(*) FROM asm
UNION ALL SELECT 'legacy_results', CASE WHEN taken THEN '1 true' ELSE '1 false' END, count(*) FROM r GROUP BY taken
UNION ALL SELECT 'legacy_results', '2 false', count(*) FROM r WHERE NOT taken HAVING count(*) > 0
UNION ALL SELECT 'quarantine', 'all', count(*) FROM pb""")

_o("stream_assessments", f"""WITH {SCORES},
s AS (SELECT assessment_id, unnest([ingested_at, ingested_at + INTERVAL 11 MINUTE]) AS sent FROM asm)
SELECT 'ids' AS table_name, '2' AS key, count(*) AS n FROM asm
UNION ALL SELECT 'forwarded', strftime(sent, '%Y-%m-%d'), count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'quarantine', 'leg', count(*) FROM asm
UNION ALL SELECT 'quarantine', 'poi', count(*) FROM pb""")

ORACLES["stream_errors"] = ORACLES["sink_errors"]

_o("v_unknown_provider", f"""WITH {GATE}
SELECT payload_id, provider, 'unknown provider: ' || provider AS error_message FROM g WHERE stage = 'provider'""")

ORACLES["q_provider_enabled"] = ORACLES["j_enabled"]
ORACLES["sink_fanout"] = ORACLES["j_fanout"]
ORACLES["agg_purge_report"] = ORACLES["purge"]

_o("q_newest_failed", f"""WITH {GATE}, {_H}
SELECT id, provider, created_at FROM held WHERE error_kind = 'parse' ORDER BY created_at DESC, id LIMIT 50""")

_o("sink_batches", f"""WITH {SCORES}, {_H},
t AS (
  SELECT 'assessments' AS table_name, provider, count(*) AS n FROM asm GROUP BY provider
  UNION ALL SELECT 'normalization_audit_log', provider, count(*) FROM asm GROUP BY provider
  UNION ALL SELECT 'failed_records', provider, count(*) FROM held GROUP BY provider
  UNION ALL SELECT 'schema_violations', provider, count(*) FROM vheld GROUP BY provider)
SELECT table_name, provider, n, n AS n_keys FROM t WHERE provider <> 'provider_c'""")

_o("replay_store", f"""WITH {SCORES},
held AS (
  SELECT provider, stage, n_assessments FROM gk WHERE stage <> 'ok' OR provider = 'provider_c'
  QUALIFY row_number() OVER (PARTITION BY provider, input_hash ORDER BY received_at, payload_id) = 1),
o AS (SELECT provider, stage = 'ok' AS ok, CASE WHEN stage = 'ok' THEN n_assessments ELSE 0 END AS n FROM held)
SELECT 'replay 1' AS step, provider, CASE WHEN ok THEN 'replayed' ELSE 'error' END AS state, count(*) AS n,
  CAST(sum(n) AS BIGINT) AS n_assessments FROM o GROUP BY ALL
UNION ALL SELECT 'replay 2', provider, CASE WHEN ok THEN 'already_replayed' ELSE 'error' END, count(*), 0 FROM o GROUP BY ALL
UNION ALL SELECT 'failed_records', provider, CASE WHEN ok THEN 'replayed' ELSE 'open' END, count(*), NULL FROM o GROUP BY ALL
UNION ALL SELECT 'stored', provider, 'pending', count(*), count(*) FROM asm WHERE provider <> 'provider_c' GROUP BY ALL
UNION ALL SELECT 'stored', provider, 'pending', CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT) FROM o WHERE ok GROUP BY ALL""")

_o("purge_store", f"""WITH {SCORES}, {_H},
t AS (
  SELECT unnest(['assessments', 'normalization_audit_log', 'outbox']) AS table_name, ingested_at AS created_at FROM asm
  UNION ALL SELECT 'failed_records', created_at FROM held
  UNION ALL SELECT 'schema_violations', created_at FROM vheld),
c AS (SELECT max(ts) - INTERVAL 10 DAY AS cutoff FROM events)
SELECT table_name, count(*) FILTER (created_at < cutoff) AS removed, count(*) FILTER (created_at >= cutoff) AS kept,
  count(*) AS held_before FROM t, c GROUP BY table_name""")

_o("sink_console", f"""WITH {SCORES}
SELECT 'console' AS sink_name, true AS ok, 1 AS attempts, count(*) AS n FROM asm""")

# a plain id in a stored raw input: the letter U and a user's number, nothing alphanumeric beside it
_o("pii_leak_tables", f"""WITH {SCORES}, {_H},
raws AS (SELECT provider, input_hash, any_value(raw) AS raw FROM gk GROUP BY ALL),
u AS (SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) AS id FROM events),
m AS (
  SELECT provider, input_hash, EXISTS (FROM u WHERE list_contains(
    regexp_split_to_array(raw, '[^A-Za-z0-9]+'), u.id)) AS leaks FROM raws),
n AS (
  SELECT 'assessments' AS table_name, count(*) AS n_rows FROM asm
  UNION ALL SELECT 'normalization_audit_log', count(*) FROM asm UNION ALL SELECT 'outbox', count(*) FROM asm
  UNION ALL SELECT 'failed_records', count(*) FROM held UNION ALL SELECT 'schema_violations', count(*) FROM vheld),
l AS (
  SELECT 'assessments' AS table_name, 'patient_id' AS column_name, count(*) AS n_leaks FROM asm
  UNION ALL SELECT 'outbox', 'payload', count(*) FROM asm
  UNION ALL SELECT 'failed_records', 'raw_input', count(*) FILTER (leaks) FROM held JOIN m USING (provider, input_hash)
  UNION ALL SELECT 'schema_violations', 'raw_input', count(*) FILTER (leaks) FROM vheld JOIN m USING (provider, input_hash))
SELECT p.policy, table_name, 'id' AS column_name, n_rows, 0 AS n_leaks FROM n, (VALUES ('strict'), ('plain')) p(policy)
UNION ALL SELECT 'plain', table_name, column_name, n_rows, n_leaks FROM l JOIN n USING (table_name)""")

# streams give what the batch queries give
ORACLES["ts_rate_stream"] = ORACLES["ts_rate"]
ORACLES["ts_alert_stream"] = ORACLES["ts_alert_sustained"]

_o("agg_histogram_batch", f"""WITH bo AS ({ORACLES["batch_outcome"]}),
bb(bucket_index, le, bound) AS (VALUES {", ".join(
    f"({i}, '{bucket_label(b)}', {b}{D})" for i, b in enumerate(BUCKETS_BATCH_SIZE))},
  ({len(BUCKETS_BATCH_SIZE)}, '+Inf', 'inf'::DOUBLE))
SELECT 'batch' AS kind, CAST(bucket_index AS INTEGER) AS bucket_index, le, count(*) FILTER (n_items <= bound) AS bucket_count
FROM bo CROSS JOIN bb GROUP BY bucket_index, le""")
