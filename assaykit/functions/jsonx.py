"""Strict JSON reading on top of VARIANT.

``try_parse_json`` accepts trailing text (``{"a":1} x``); see
:func:`strict_parse_sql` for the check that rejects it. Type tests read ``schema_of_variant`` of the addressed value, because
``try_variant_get(..., 'string')`` would also turn numbers into strings.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMERIC_TYPES_RE = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def strict_wrappers_sql(raw: str) -> tuple[str, str]:
    """The two wrapper parses used by :func:`strict_from_wrappers_sql`."""
    return (f"try_parse_json(concat('[', {raw}, ']'))",
            f"CASE WHEN instr({raw}, ']') > 0 THEN try_parse_json(concat('[', {raw}, ',1]')) "
            "ELSE parse_json('[null,1]') END")


def strict_from_wrappers_sql(w1: str, w2: str) -> str:
    """VARIANT of ``raw`` only when the whole text is exactly one JSON value.

    The parser stops after the first value and ignores what follows, so the
    text is parsed twice inside two different wrappers, ``[raw]`` (``w1``)
    and ``[raw,1]`` (``w2``). If ``raw`` closed the wrapper early, both
    parses end inside ``raw`` and give the same array; only a complete single
    value yields sizes 1 and 2. The value itself is taken from ``w1``. A text
    without ``]`` cannot close the wrapper, so its ``w2`` is not parsed: it is
    an array of two values whatever the text.
    Pass column names so each parse runs once per row.
    """
    return (f"CASE WHEN try_variant_get({w1}, '$[0]', 'variant') IS NOT NULL "
            f"AND try_variant_get({w1}, '$[1]', 'variant') IS NULL "
            f"AND try_variant_get({w2}, '$[1]', 'variant') IS NOT NULL "
            f"AND try_variant_get({w2}, '$[2]', 'variant') IS NULL "
            f"THEN try_variant_get({w1}, '$[0]', 'variant') END")


def strict_parse_sql(raw: str) -> str:
    """Single-expression form (parses inline; prefer the two-column form in plans)."""
    return strict_from_wrappers_sql(*strict_wrappers_sql(raw))


def strict_parse(raw: str) -> Column:
    return F.expr(strict_parse_sql(raw))


def vtype_sql(v: str, path: str = "$") -> str:
    """Variant type name at a path; NULL when the path is absent."""
    if path == "$":
        return f"schema_of_variant({v})"
    return f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))"


def is_string_sql(v: str, path: str) -> str:
    return f"coalesce({vtype_sql(v, path)} = 'STRING', false)"


def is_object_sql(v: str, path: str) -> str:
    return f"(try_variant_get({v}, '{path}', 'map<string,variant>') IS NOT NULL)"


def is_present_sql(v: str, path: str) -> str:
    return f"(try_variant_get({v}, '{path}', 'variant') IS NOT NULL)"


def null_or_string_sql(v: str, path: str) -> str:
    """Absent, JSON null, or a string (an optional string field)."""
    t = vtype_sql(v, path)
    return f"coalesce({t} IN ('STRING', 'VOID'), true)"


def is_numeric_sql(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) rlike '{NUMERIC_TYPES_RE}', false)"
