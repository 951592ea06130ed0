"""Content hashes and deterministic identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def input_hash(raw: Column) -> Column:
    """Plain SHA-256 hex of the payload bytes (no prefix, unlike the PII hash)."""
    return F.sha2(raw.cast("binary"), 256)


def input_size(raw: Column) -> Column:
    return F.octet_length(raw).cast("int")


def uuid_from(*parts: Column) -> Column:
    """A UUID-shaped id derived from the given parts.

    Deterministic, so a retried task or a re-run batch produces the same key
    and the idempotent sinks can drop the repeat.
    """
    h = F.sha2(F.concat_ws("#", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4),
                       h.substr(17, 4), h.substr(21, 12))


def uuid_text(*parts: object) -> str:
    """:func:`uuid_from` of known values, without a Spark job."""
    h = hashlib.sha256("#".join(str(p) for p in parts if p is not None).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def uuid_sql(expr: str) -> str:
    """DuckDB/Spark-portable SQL form of :func:`uuid_from` for one part."""
    h = f"sha256({expr})"
    return (f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), "
            f"substr({h},17,4), substr({h},21,12))")
