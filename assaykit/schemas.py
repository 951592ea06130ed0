"""Declared schemas and fixed values.

Schemas are declared, never inferred. The constants in the "fixed values"
block must equal the behaviour being reproduced (provider names, formats,
messages' vocabulary, thresholds, bucket bounds); they are listed plainly
and together.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written)
# ---------------------------------------------------------------------------
PROVIDER_A = "provider_a"
PROVIDER_B = "provider_b"
PROVIDER_C = "provider_c"
PROVIDER_FORMATS = {
    PROVIDER_A: "nested_json",
    PROVIDER_B: "flat_kv",
    PROVIDER_C: "csv",
}
SCHEMA_VERSION = "1.0"
TARGET_SCALE = "0-100"
SCORE_PREFIX = "score_"
CSV_COLUMNS = ["patient_id", "assessment_date", "metric_name", "metric_value", "category"]
SCALE_PRESETS = {"0-10": (0.0, 10.0), "0-5": (0.0, 5.0), "0-100": (0.0, 100.0)}
REDACTED = "[REDACTED]"
HMAC_PREFIX = "sha256:"

BOUNDARY_PRE = "pre_transform"
BOUNDARY_POST = "post_transform"

# error kinds produced by the gate
KIND_VALIDATION = "validation"
KIND_UNKNOWN_PROVIDER = "unknown_provider"
KIND_PARSE = "parse"
KIND_SERIALIZATION = "serialization"

OUTBOX_PENDING = "pending"
OUTBOX_FLUSHED = "flushed"
OUTBOX_FAILED = "failed"
OUTBOX_MAX_RETRIES = 10          # retries reaching 10 marks the row failed
SWEEP_STALE_SECS = 300
SWEEP_BATCH_LIMIT = 100
SWEEP_INTERVAL_SECS = 60
DEDUP_WINDOW_SECS = 600
MAX_DELIVER = 5
RETENTION_DAYS = 90
RETRY_MAX_ATTEMPTS = 3
RETRY_BASE_DELAY_MS = 100
RETRY_MAX_DELAY_MS = 5000
DB_RETRY_DELAY_SECS = 5          # redelivery delay after a storage failure
SINK_RETRY_DELAY_SECS = 10       # redelivery delay after a legacy sink failure
STREAM_MAX_AGE_DAYS = {"assessments": 7, "errors": 30, "outbox": 7}

FAILED_RECORDS_CRITICAL = 10
OUTBOX_PENDING_WARN = 5
VIOLATIONS_LOOKBACK_HOURS = 1

# lower-cased substrings that mark a storage error as transient
TRANSIENT_PATTERNS = [
    "connection refused",
    "connection reset",
    "broken pipe",
    "timed out",
    "timeout",
    "could not serialize access",
    "too many connections",
    "pool timed out",
]

# histogram upper bounds (seconds, or items for batch size)
BUCKETS_HTTP_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
BUCKETS_DB_SINK_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
BUCKETS_DELIVERY_SECONDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
BUCKETS_BATCH_SIZE = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]

SLO_TARGET = 0.999

# alert rules: (name, metric, comparison, threshold, for_seconds, severity)
ALERT_RULES = [
    ("HighErrorRate", "error_ratio_5m", ">", 0.05, 120, "critical"),
    ("ElevatedErrorRate", "error_ratio_15m", ">", 0.01, 900, "warning"),
    ("HighLatency", "latency_p99_5m", ">", 1.0, 300, "warning"),
    ("HighFailureRate", "failure_ratio_5m", ">", 0.1, 300, "warning"),
    ("FailedRecordsPending", "failed_records_pending", ">", 10.0, 600, "warning"),
    ("FailedRecordsCritical", "failed_records_pending", ">", 50.0, 300, "critical"),
    ("SchemaViolations", "schema_violations_recent", ">", 5.0, 600, "warning"),
    ("ConsumerLag", "consumer_pending", ">", 100.0, 300, "warning"),
    ("ConsumerLagCritical", "consumer_pending", ">", 1000.0, 120, "critical"),
    ("OutboxBacklogGrowing", "outbox_pending", ">", 100.0, 300, "warning"),
    ("OutboxBacklogCritical", "outbox_pending", ">", 1000.0, 120, "critical"),
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("payload_id", T.StringType(), False),
    T.StructField("provider", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("received_at", T.TimestampType(), True),
])

SCORE = T.StructType([
    T.StructField("dimension", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("scale", T.StringType()),
])

VIOLATION = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("actual", T.StringType()),
    T.StructField("message", T.StringType()),
])

FIELD_ERROR = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
])

ASSESSMENTS_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("patient_id", T.StringType()),
    T.StructField("assessment_date", T.TimestampType()),
    T.StructField("assessment_type", T.StringType()),
    T.StructField("scores", T.ArrayType(SCORE)),
    T.StructField("source_provider", T.StringType()),
    T.StructField("source_format", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("version", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

AUDIT_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("assessment_id", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("source_format", T.StringType()),
    T.StructField("input_hash", T.StringType()),
    T.StructField("input_size_bytes", T.IntegerType()),
    T.StructField("score_count", T.IntegerType()),
    T.StructField("transformations", T.StringType()),
    T.StructField("duration_us", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

VIOLATIONS_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("boundary", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("input_hash", T.StringType()),
    T.StructField("violations", T.ArrayType(VIOLATION)),
    T.StructField("raw_input", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

OUTBOX_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("assessment_id", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("retries", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("flushed_at", T.TimestampType()),
])

FAILED_TABLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("provider", T.StringType()),
    T.StructField("raw_input", T.StringType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("error_detail", T.StringType()),
    T.StructField("input_hash", T.StringType()),
    T.StructField("replayed", T.BooleanType()),
    T.StructField("replayed_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
])

SINK_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("sink_type", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("request_timeout_secs", T.IntegerType()),
])
KNOWN_SINK_TYPES = ["http_json", "stdout"]
