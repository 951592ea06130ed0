"""Identifier scrubbing as native column expressions.

HMAC-SHA256 is written with ``sha2``/``unhex``/``concat`` so it runs inside
whole-stage codegen; only the two 64-byte pads are derived on the driver from
the salt (a job parameter, not data).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from assaykit.schemas import HMAC_PREFIX, REDACTED

_BLOCK = 64
MIN_SALT_CHARS = 32


def _pads(salt: str) -> tuple[str, str]:
    key = salt.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    return ipad, opad


def hmac_sha256_hex(col: Column, salt: str) -> Column:
    """``sha256:`` + hex(HMAC-SHA256(salt, col)) over the UTF-8 bytes of col."""
    ipad, opad = _pads(salt)
    msg = col.cast("binary")
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad)), msg), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(opad)), F.unhex(inner)), 256)
    return F.concat(F.lit(HMAC_PREFIX), outer)


def hmac_sql(expr: str, salt: str) -> str:
    """The same HMAC as a Spark SQL snippet (for selectExpr / spark.sql)."""
    ipad, opad = _pads(salt)
    return (f"concat('{HMAC_PREFIX}', sha2(concat(unhex('{opad}'), "
            f"unhex(sha2(concat(unhex('{ipad}'), cast({expr} as binary)), 256))), 256))")


def redact(_col: Column | None = None) -> Column:
    return F.lit(REDACTED)


@dataclass(frozen=True)
class PiiPolicy:
    """Scrubbing policy; strategies are ``hash`` or ``redact``."""

    enabled: bool = True
    patient_id_strategy: str = "hash"
    raw_input_strategy: str = "hash"
    hash_salt: str = "change-me-to-a-secret-salt-of-32-chars"
    allow_internal_pii: bool = False
    store_patient_id_plaintext: bool = False
    store_raw_for_replay: bool = False
    provider_fields: dict = field(default_factory=dict)

    def __post_init__(self):
        for s in (self.patient_id_strategy, self.raw_input_strategy):
            if s not in ("hash", "redact"):
                raise ValueError(f"unknown scrub strategy: {s}")
        if not self.allow_internal_pii and (self.store_patient_id_plaintext or self.store_raw_for_replay):
            raise ValueError("internal plaintext storage requires allow_internal_pii")
        if not self.enabled:
            raise ValueError("scrubbing cannot be switched off")
        if "hash" in (self.patient_id_strategy, self.raw_input_strategy) and len(self.hash_salt) < MIN_SALT_CHARS:
            raise ValueError(f"the hash strategy needs a salt of at least {MIN_SALT_CHARS} characters")

    @property
    def stores_patient_plaintext(self) -> bool:
        return self.allow_internal_pii and self.store_patient_id_plaintext

    @property
    def stores_raw(self) -> bool:
        return self.allow_internal_pii and self.store_raw_for_replay


STRICT = PiiPolicy()


def scrub(col: Column, strategy: str, salt: str) -> Column:
    return hmac_sha256_hex(col, salt) if strategy == "hash" else F.lit(REDACTED)


def scrub_patient_id(col: Column, policy: PiiPolicy) -> Column:
    return scrub(col, policy.patient_id_strategy, policy.hash_salt)


def patient_id_for_storage(col: Column, policy: PiiPolicy) -> Column:
    """Plaintext only if internal PII is allowed and plaintext storage is on."""
    return col if policy.stores_patient_plaintext else scrub_patient_id(col, policy)


def raw_input_for_storage(col: Column, policy: PiiPolicy) -> Column:
    return col if policy.stores_raw else scrub(col, policy.raw_input_strategy, policy.hash_salt)


def patient_id_external(stored: Column, policy: PiiPolicy) -> Column:
    """Scrub at the edge only when the stored value is plaintext (never double-hash)."""
    return scrub_patient_id(stored, policy) if policy.stores_patient_plaintext else stored


def _variant_text(v: str) -> str:
    # SQL: the text a rule scrubs (string values without quotes, others as JSON)
    return f"coalesce(try_variant_get({v}, '$', 'string'), to_json({v}))"


def _rule_case(k: str, v: str, rules: list[tuple[str, str]], salt: str) -> str:
    arms = []
    for name, strategy in rules:
        if strategy == "hash":
            repl = hmac_sql(_variant_text(v), salt)
        else:
            repl = f"'{REDACTED}'"
        arms.append(f"WHEN {k} = '{name}' THEN parse_json(concat('\"', {repl}, '\"'))")
    return "CASE " + " ".join(arms) + f" ELSE {v} END"


def scrub_fields_sql(raw_sql: str, rules: list[tuple[str, str]], salt: str) -> str:
    """Rewrite a JSON payload with per-field rules, as a SQL expression.

    A rule names a key; it applies at the top level and inside any object one
    level down (``name`` reaches ``patient.name``). Values are replaced by
    their scrubbed text; non-JSON payloads pass through unchanged.
    """
    if not rules:
        return raw_sql
    inner = _rule_case("k2", "v2", rules, salt)
    nested = (f"coalesce(to_variant_object(transform_values(try_variant_get(v, '$', 'map<string,variant>'), "
              f"(k2, v2) -> {inner})), v)")
    outer = _rule_case("k", nested, rules, salt)
    m = f"try_variant_get(try_parse_json({raw_sql}), '$', 'map<string,variant>')"
    return f"CASE WHEN {m} IS NULL THEN {raw_sql} ELSE to_json(transform_values({m}, (k, v) -> {outer})) END"


def scrub_fields(raw_sql: str, rules: list[tuple[str, str]], salt: str) -> Column:
    """Column form of :func:`scrub_fields_sql`; ``raw_sql`` is a column name or SQL expression."""
    return F.expr(scrub_fields_sql(raw_sql, rules, salt))
