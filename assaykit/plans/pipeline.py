"""The staged normalization gate and the tables it feeds.

``run_gate`` turns a ``payloads`` DataFrame into one row per payload with the
outcome of every stage:

    pre-transform validation -> typed parse -> normalize ->
    post-transform validation -> output check -> PII scrub

A later stage only counts when every earlier one passed (``CASE`` order), and
the first failure decides ``error_kind``. The whole gate is a chain of
per-row expressions over one strict VARIANT parse of the payload: no
exchange, no Python, so it fuses into whole-stage code and scales with the
number of input splits. The derived tables (assessments, audit, outbox,
failures, violations) are narrow projections of the gate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assaykit.functions import hashing, pii
from assaykit.functions.times import now_utc, utc_ntz
from assaykit.functions.jsonx import strict_from_wrappers_sql, strict_wrappers_sql
from assaykit.operators import normalize as N
from assaykit.operators import validate as V
from assaykit.operators.providers import Provider, with_text
from assaykit.schemas import (
    BOUNDARY_POST, BOUNDARY_PRE, KIND_PARSE, KIND_UNKNOWN_PROVIDER, KIND_VALIDATION,
    OUTBOX_PENDING, PROVIDER_A, PROVIDER_B, PROVIDER_C, PROVIDER_FORMATS, SCHEMA_VERSION,
)

STAGE_OK = "ok"
STAGES = ["provider", "pre", "deep", "normalize", "post", "output"]
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"   # NTZ values are UTC wall clock


@dataclass(frozen=True)
class GateConfig:
    policy: pii.PiiPolicy = pii.STRICT
    enabled: tuple[str, ...] = ()          # empty = every known provider
    declared: tuple[Provider, ...] = ()    # beside the built-in ones

    @property
    def formats(self) -> dict[str, str]:
        return PROVIDER_FORMATS | {p.name: p.format for p in self.declared}

    @property
    def providers(self) -> list[str]:
        return [p for p in self.formats if not self.enabled or p in self.enabled]


GATE_PARTITIONS_CONF = "spark.assaykit.gate.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal the payloads out evenly before the CPU-heavy gate.

    How many tasks read the input says nothing of how many can work on it: a
    Parquet file of one row group is one task, whatever its size on disk. The
    payloads are dealt to ``spark.assaykit.gate.partitions`` partitions where
    that is set (local sessions: the core count, see
    :func:`assaykit.session.get_spark`), else to the session's shuffle
    partitions, four a core at least, so that no core waits long for the last.

    :func:`run_gate` deals by itself only in local sessions. Elsewhere its
    payloads keep the splits they come in, and a caller deals them, or the
    smaller rows they are made from, where these may be few.
    """
    conf = df.sparkSession.conf
    n = conf.get(GATE_PARTITIONS_CONF, None)
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(n) if n else max(int(conf.get("spark.sql.shuffle.partitions")), least))


def _with_each(df: DataFrame, cols: dict) -> DataFrame:
    for name, col in cols.items():
        df = df.withColumn(name, col)
    return df


def _case_provider(arms: dict[str, str], default: str = "NULL") -> str:
    body = " ".join(f"WHEN '{p}' THEN {e}" for p, e in arms.items())
    return f"CASE provider {body} ELSE {default} END"


def run_gate(payloads: DataFrame, config: GateConfig = GateConfig(), carry: tuple[str, ...] = (),
             only: Column | None = None) -> DataFrame:
    """Run every stage for every payload; see the module docstring.

    :func:`decided` has the arguments; :func:`finished` adds what depends on the policy, so that several policies may
    share one run of the stages.
    """
    return finished(decided(payloads, config, carry, only), config, carry)


def decided(payloads: DataFrame, config: GateConfig = GateConfig(), carry: tuple[str, ...] = (),
            only: Column | None = None) -> DataFrame:
    """The stage that every payload reached and what the stages made of it, whatever the policy.

    ``only`` is a condition on the payload columns; it is applied before the
    first parse, because filters on the result cannot pass the barrier below.

    ``carry`` names extra input columns passed through unchanged (e.g. the
    submission a batch item belongs to), so callers need no join back.
    """
    providers = config.providers
    known = F.coalesce(F.col("provider").isin(providers), F.lit(False)) if providers else F.lit(False)
    if only is not None:
        payloads = payloads.filter(only)
    received = utc_ntz(F.col("received_at"), payloads.schema["received_at"].dataType)
    declared = config.declared
    if payloads.sparkSession.conf.get(GATE_PARTITIONS_CONF, None):
        payloads = spread(payloads)
    df = with_text(payloads, declared).select(
        *carry, "payload_id", "provider", "raw", "_text", received.alias("received_at"),
        F.coalesce(received, now_utc()).alias("ingested_at"),
        known.alias("known"),
    )
    # one strict parse per JSON payload, reused by every later stage; the two
    # wrapper parses are columns of their own so each runs once per row
    w1, w2 = strict_wrappers_sql("_text")
    is_json = "provider IN (" + ", ".join(f"'{p}'" for p in (PROVIDER_A, PROVIDER_B, *(d.name for d in declared))) + ")"
    df = _with_each(df, {"_w1": F.expr(f"CASE WHEN {is_json} THEN {w1} END"),
                         "_w2": F.expr(f"CASE WHEN {is_json} THEN {w2} END")})
    df = df.withColumn("v", F.expr(strict_from_wrappers_sql("_w1", "_w2")))
    # each JSON object becomes a map once; all checks read from these maps
    df = df.withColumn("m", F.expr("try_variant_get(v, '$', 'map<string,variant>')"))
    df = _with_each(df, {
        "pm": F.expr(f"CASE WHEN provider = '{PROVIDER_A}' THEN "
                     "try_variant_get(try_element_at(m, 'patient'), '$', 'map<string,variant>') END"),
        "am": F.expr(f"CASE WHEN provider = '{PROVIDER_A}' THEN "
                     "try_variant_get(try_element_at(m, 'assessment'), '$', 'map<string,variant>') END"),
    })
    df = _with_each(df, {
        "sm": F.expr("try_variant_get(try_element_at(am, 'scores'), '$', 'map<string,variant>')"),
        "bsc": F.expr(f"CASE WHEN provider = '{PROVIDER_B}' THEN {N.b_scores()} END"),
    })
    for name, col in N.csv_columns().items():
        df = df.withColumn(name, col)
    df = df.withColumn("pre", F.expr(
        "CASE WHEN known THEN " + _case_provider(
            {PROVIDER_A: V.pre_a(), PROVIDER_B: V.pre_b(), PROVIDER_C: V.pre_c(), **{d.name: d.pre for d in declared}})
        + " END"))
    df = _with_each(df, {
        "deep_ok": F.expr(_case_provider(
            {PROVIDER_A: V.deep_a(), PROVIDER_B: V.deep_b(), PROVIDER_C: V.deep_c(),
             **{d.name: d.deep for d in declared}}, "false")),
        "b_has_numeric": F.expr(f"CASE WHEN provider = '{PROVIDER_B}' THEN coalesce(size(bsc) > 0, false) ELSE true END"),
        "csv_sorted": F.expr(f"CASE WHEN provider = '{PROVIDER_C}' THEN {N.c_sorted()} END"),
    })
    df = _with_each(df, {"csv_starts": F.expr(N.c_starts()), "csv_keys": F.expr(N.c_group_keys())})
    reached_norm = "known AND size(pre) = 0 AND deep_ok AND b_has_numeric"
    df = df.withColumn("norm_ok", F.expr(
        f"CASE WHEN {reached_norm} THEN "
        + _case_provider({PROVIDER_C: N.norm_c_ok()}, "true") + " ELSE false END"))
    df = df.withColumn("assessments", F.expr(
        f"CASE WHEN {reached_norm} AND norm_ok THEN "
        + _case_provider({PROVIDER_A: N.norm_a(), PROVIDER_B: N.norm_b(), PROVIDER_C: N.norm_c(),
                            **{d.name: d.normalize for d in declared}}) + " END"))
    df = df.withColumn("post", F.expr(f"CASE WHEN assessments IS NOT NULL THEN {V.post()} END"))
    # The output re-check tests a subset of the post-transform conditions
    # (empty ids, empty scores, range, empty dimension), so after a clean
    # post check it cannot fail; it is recorded as passed without another
    # pass over the scores. ``validate.output_errors()`` stays available
    # for callers that check stored assessments directly.
    df = df.withColumn("out_errors", F.expr(
        "CASE WHEN assessments IS NOT NULL AND size(post) = 0 "
        "THEN filter(array(named_struct('field', '', 'message', '')), x -> false) END"))
    df = df.withColumn("stage", F.expr(
        "CASE WHEN NOT known THEN 'provider' "
        "WHEN size(pre) > 0 THEN 'pre' "
        "WHEN NOT deep_ok OR NOT b_has_numeric THEN 'deep' "
        "WHEN NOT norm_ok THEN 'normalize' "
        "WHEN size(post) > 0 THEN 'post' "
        "WHEN size(out_errors) > 0 THEN 'output' "
        f"ELSE '{STAGE_OK}' END"))
    # Close the decision part with a one-element generator: later filters on
    # the outcome (stage = 'post', provider = ...) stop here instead of being
    # pushed below the projections, where they would re-expand every stage
    # expression into the filter condition. Everything derived below this
    # point (hashes, audit JSON, HMAC scrub, messages) stays prunable, so a
    # query that only needs the stage does not compute them.
    kept = [*carry, "payload_id", "provider", "raw", "received_at", "ingested_at", "pre", "deep_ok", "b_has_numeric",
            "norm_ok", "csv_keys", "assessments", "post", "out_errors", "stage"]
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in kept]))))


def finished(df: DataFrame, config: GateConfig = GateConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Decided payloads with hashes, errors, audit steps and scrubbed assessments."""
    df = df.withColumns({
        "input_hash": hashing.input_hash(F.col("raw")),
        "input_size_bytes": hashing.input_size(F.col("raw")),
    })
    df = _classify(df)
    df = _audit_steps(df, config.policy)
    df = _scrub(df, config.policy)
    return df.select(
        *carry, "payload_id", "provider", N.source_format(F.col("provider"), config.formats).alias("source_format"),
        "raw", "received_at", "ingested_at", "input_hash", "input_size_bytes", "stage",
        "error_kind", "error_message", "field_errors",
        F.coalesce("pre", F.expr("filter(array(named_struct('field', '', 'expected', '', 'actual', '', "
                                 "'message', '')), x -> false)")).alias("pre_violations"),
        F.when(F.col("stage") == "post", F.col("post")).alias("post_violations"),
        "assessments",
        F.expr("coalesce(aggregate(assessments, 0, (acc, a) -> acc + size(a.scores)), 0)").alias("score_count"),
        "transformations",
    )


def _classify(df: DataFrame) -> DataFrame:
    """Error kind, message and field errors from the failed stage."""
    return _with_each(df, {
        "error_kind": F.expr(
            f"CASE stage WHEN 'provider' THEN '{KIND_UNKNOWN_PROVIDER}' "
            f"WHEN 'pre' THEN '{KIND_VALIDATION}' "
            f"WHEN 'deep' THEN CASE WHEN deep_ok THEN '{KIND_VALIDATION}' ELSE '{KIND_PARSE}' END "
            f"WHEN 'normalize' THEN '{KIND_PARSE}' "
            f"WHEN 'post' THEN '{KIND_VALIDATION}' WHEN 'output' THEN '{KIND_VALIDATION}' END"),
        "field_errors": F.expr(
            f"CASE stage WHEN 'pre' THEN {V.violations_to_errors('pre')} "
            f"WHEN 'deep' THEN CASE WHEN deep_ok THEN {V.B_NO_NUMERIC_ERRORS} END "
            f"WHEN 'post' THEN {V.violations_to_errors('post')} "
            f"WHEN 'output' THEN out_errors END"),
    }).withColumn("error_message", F.expr(
        "CASE stage WHEN 'provider' THEN concat('unknown provider: ', coalesce(provider, '')) "
        "WHEN 'deep' THEN CASE WHEN deep_ok THEN 'validation failed' "
        "ELSE 'parse error: payload does not match the provider schema' END "
        f"WHEN 'normalize' THEN {N.norm_c_error()} "
        f"WHEN '{STAGE_OK}' THEN NULL ELSE 'validation failed' END"))


def _audit_steps(df: DataFrame, policy: pii.PiiPolicy) -> DataFrame:
    """Ordered step list (JSON) like the audit trail: name + outcome details."""
    scrubbed = not policy.stores_patient_plaintext
    strategy = policy.patient_id_strategy.capitalize() if scrubbed else "plaintext_internal"

    def step(name, passed=None, violations=None, records=None, scores=None, extra=None):
        parts = [f"'step', '{name}'",
                 f"'passed', {passed or 'CAST(NULL AS boolean)'}",
                 f"'violations', {violations or 'CAST(NULL AS int)'}",
                 f"'records', {records or 'CAST(NULL AS int)'}",
                 f"'scores_produced', {scores or 'CAST(NULL AS int)'}",
                 f"'patient_id_scrubbed', {extra[0] if extra else 'CAST(NULL AS boolean)'}",
                 f"'strategy', {extra[1] if extra else 'CAST(NULL AS string)'}"]
        return "named_struct(" + ", ".join(parts) + ")"

    order = {s: i for i, s in enumerate(STAGES)}
    steps = [
        ("stage != 'provider'", step("validate_pre_transform", "size(pre) = 0", "size(pre)")),
        (f"stage NOT IN ('provider', 'pre')", step("validate_input", "(deep_ok AND b_has_numeric)")),
        (f"stage NOT IN ('provider', 'pre', 'deep')",
         step("normalize", "CASE WHEN norm_ok THEN NULL ELSE false END", None,
              "CASE WHEN norm_ok THEN size(assessments) END",
              "CASE WHEN norm_ok THEN aggregate(assessments, 0, (acc, a) -> acc + size(a.scores)) END")),
        (f"stage NOT IN ('provider', 'pre', 'deep', 'normalize')",
         step("validate_post_transform", "size(post) = 0", "size(post)")),
        (f"stage IN ('output', '{STAGE_OK}')", step("validate_output", f"stage = '{STAGE_OK}'")),
        (f"stage = '{STAGE_OK}'", step("pii_scrub", extra=(str(scrubbed).lower(), f"'{strategy}'"))),
    ]
    del order
    arr = "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN {s} END" for c, s in steps) + "))"
    return df.withColumn("transformations", F.to_json(F.expr(arr)))


def _scrub(df: DataFrame, policy: pii.PiiPolicy) -> DataFrame:
    """Patient ids as stored: plaintext only under an internal-PII policy."""
    if policy.stores_patient_plaintext:
        return df
    if policy.patient_id_strategy == "hash":
        pid = pii.hmac_sql("a.patient_id", policy.hash_salt)
    else:
        pid = "'[REDACTED]'"
    return df.withColumn("assessments", F.expr(
        f"transform(assessments, a -> named_struct('patient_id', {pid}, "
        "'assessment_date', a.assessment_date, 'assessment_type', a.assessment_type, 'scores', a.scores))"))


# ---------------------------------------------------------------------------
# Tables derived from the gate (narrow projections, no shuffle)
# ---------------------------------------------------------------------------

def stored_raw(policy: pii.PiiPolicy) -> Column:
    """What is stored of a failed payload: scrubbed whole, or kept with its provider's field rules applied."""
    if not policy.stores_raw or not policy.provider_fields:
        return pii.raw_input_for_storage(F.col("raw"), policy)
    return F.expr(_case_provider({p: pii.scrub_fields_sql("raw", list(rules), policy.hash_salt)
                                  for p, rules in policy.provider_fields.items()}, "raw"))


def assessment_rows(gate: DataFrame) -> DataFrame:
    """One row per unified assessment of a successful payload.

    The outer generator adds no ``size(assessments) > 0`` filter, which would
    compute the scrubbed array (its HMACs) again for every payload.
    """
    ok = gate.filter(F.col("stage") == STAGE_OK)
    rows = ok.select(
        "payload_id", "provider", "source_format", "ingested_at", "input_hash", "input_size_bytes",
        "score_count", "transformations",
        F.posexplode_outer("assessments").alias("assessment_index", "a"))
    return rows.filter(F.col("assessment_index").isNotNull()).select(
        hashing.uuid_from(F.col("payload_id"), F.col("assessment_index")).alias("id"),
        F.col("a.patient_id").alias("patient_id"),
        F.col("a.assessment_date").alias("assessment_date"),
        F.col("a.assessment_type").alias("assessment_type"),
        F.col("a.scores").alias("scores"),
        F.col("provider").alias("source_provider"),
        "source_format", "ingested_at",
        F.lit(SCHEMA_VERSION).alias("version"),
        F.col("ingested_at").alias("created_at"),
        "payload_id", "assessment_index", "input_hash", "input_size_bytes", "score_count", "transformations",
    )


def camel_json(assessments: DataFrame) -> F.Column:
    """The unified assessment as camelCase JSON (external representation)."""
    obj = F.struct(
        F.col("id").alias("id"), F.col("patient_id").alias("patientId"),
        F.col("assessment_date").alias("assessmentDate"), F.col("assessment_type").alias("assessmentType"),
        F.col("scores").alias("scores"),
        F.struct(F.col("source_provider").alias("sourceProvider"), F.col("source_format").alias("sourceFormat"),
                 F.col("ingested_at").alias("ingestedAt"), F.col("version").alias("version")).alias("metadata"))
    return F.to_json(obj, {"timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_NTZ_FORMAT})


def audit_payload(assessments: DataFrame) -> F.Column:
    return F.struct(
        "input_hash", "input_size_bytes",
        F.parse_json(F.col("transformations")).alias("transformations"),
        F.lit(None).cast("long").alias("duration_us"),
        F.col("source_provider").alias("provider"), "source_format", "score_count")


def envelope_json(assessments: DataFrame) -> F.Column:
    """``{assessment, audit}``: what the outbox stores and the stream carries."""
    return F.concat(F.lit('{"assessment":'), camel_json(assessments),
                    F.lit(',"audit":'), F.to_json(audit_payload(assessments)), F.lit("}"))


def audit_rows(assessments: DataFrame) -> DataFrame:
    return assessments.select(
        hashing.uuid_from(F.lit("audit"), F.col("id")).alias("id"),
        F.col("id").alias("assessment_id"),
        F.col("source_provider").alias("provider"), "source_format", "input_hash", "input_size_bytes",
        "score_count", "transformations", F.lit(None).cast("long").alias("duration_us"), "created_at")


def outbox_rows(assessments: DataFrame) -> DataFrame:
    return assessments.select(
        hashing.uuid_from(F.lit("outbox"), F.col("id")).alias("id"),
        F.col("id").alias("assessment_id"),
        envelope_json(assessments).alias("payload"),
        F.lit(OUTBOX_PENDING).alias("status"), F.lit(0).alias("retries"),
        "created_at", F.lit(None).cast("timestamp_ntz").alias("flushed_at"))


def failed_rows(gate: DataFrame, policy: pii.PiiPolicy = pii.STRICT) -> DataFrame:
    bad = gate.filter(F.col("stage") != STAGE_OK)
    detail = F.to_json(F.struct(F.col("error_message").alias("message"),
                                F.col("field_errors").alias("errors")))
    return bad.select(
        hashing.uuid_from(F.lit("failed"), F.col("input_hash"), F.col("provider")).alias("id"),
        "provider", stored_raw(policy).alias("raw_input"),
        "error_kind", detail.alias("error_detail"), "input_hash",
        F.lit(False).alias("replayed"), F.lit(None).cast("timestamp_ntz").alias("replayed_at"),
        F.col("ingested_at").alias("created_at"), "payload_id")


def violation_rows(gate: DataFrame, policy: pii.PiiPolicy = pii.STRICT) -> DataFrame:
    """One row per (payload, boundary) that produced violations."""
    bad = gate.filter(F.col("stage").isin("pre", "post"))
    per_boundary = bad.select(
        "provider", "input_hash", "raw", "ingested_at", "payload_id",
        F.explode(F.array(
            F.struct(F.lit(BOUNDARY_PRE).alias("boundary"), F.col("pre_violations").alias("violations")),
            F.struct(F.lit(BOUNDARY_POST).alias("boundary"), F.col("post_violations").alias("violations")),
        )).alias("b")).filter(F.size("b.violations") > 0)
    return per_boundary.select(
        hashing.uuid_from(F.lit("violation"), F.col("b.boundary"), F.col("provider"), F.col("input_hash")).alias("id"),
        F.col("b.boundary").alias("boundary"), "provider", "input_hash",
        F.col("b.violations").alias("violations"),
        stored_raw(policy).alias("raw_input"),
        F.col("ingested_at").alias("created_at"), "payload_id")


def error_events(gate: DataFrame, policy: pii.PiiPolicy = pii.STRICT) -> DataFrame:
    """Error-stream messages: kind, hash, scrubbed reference, violations with boundary."""
    bad = gate.filter(F.col("stage") != STAGE_OK)
    tagged = F.expr(
        "concat(transform(pre_violations, x -> named_struct('boundary', 'pre_transform', 'provider', provider, "
        "'field', x.field, 'expected', x.expected, 'actual', x.actual, 'message', x.message)), "
        "transform(coalesce(post_violations, filter(pre_violations, x -> false)), x -> named_struct("
        "'boundary', 'post_transform', 'provider', provider, 'field', x.field, 'expected', x.expected, "
        "'actual', x.actual, 'message', x.message)))")
    return bad.select(
        "payload_id", "provider", "error_kind", F.col("input_hash").alias("raw_input_hash"),
        stored_raw(policy).alias("raw_input_ref"),
        "error_message", tagged.alias("violations"), F.col("ingested_at").alias("created_at"))


ENVELOPE_SCHEMA = (
    "assessment struct<id: string, patientId: string, assessmentDate: timestamp, assessmentType: string, "
    "scores: array<struct<dimension: string, value: double, scale: string>>, "
    "metadata: struct<sourceProvider: string, sourceFormat: string, ingestedAt: timestamp, version: string>>, "
    "audit struct<input_hash: string, input_size_bytes: int, transformations: variant, duration_us: bigint, "
    "provider: string, source_format: string, score_count: int>")


def rows_from_envelopes(messages: DataFrame, body: str = "body") -> DataFrame:
    """Envelope JSON -> assessment-row shape (the inverse of :func:`envelope_json`)."""
    e = messages.select(F.from_json(F.col(body), ENVELOPE_SCHEMA, {"timestampFormat": TS_FORMAT}).alias("e"))
    a, au = "e.assessment", "e.audit"
    return e.select(
        F.col(f"{a}.id").alias("id"), F.col(f"{a}.patientId").alias("patient_id"),
        utc_ntz(F.col(f"{a}.assessmentDate")).alias("assessment_date"),
        F.col(f"{a}.assessmentType").alias("assessment_type"),
        F.col(f"{a}.scores").alias("scores"), F.col(f"{a}.metadata.sourceProvider").alias("source_provider"),
        F.col(f"{a}.metadata.sourceFormat").alias("source_format"),
        utc_ntz(F.col(f"{a}.metadata.ingestedAt")).alias("ingested_at"),
        F.col(f"{a}.metadata.version").alias("version"),
        utc_ntz(F.col(f"{a}.metadata.ingestedAt")).alias("created_at"),
        F.col(f"{au}.input_hash").alias("input_hash"), F.col(f"{au}.input_size_bytes").alias("input_size_bytes"),
        F.col(f"{au}.score_count").alias("score_count"),
        F.to_json(F.col(f"{au}.transformations")).alias("transformations"))
