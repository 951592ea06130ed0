"""Retry arithmetic and error classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assaykit.schemas import RETRY_BASE_DELAY_MS, RETRY_MAX_DELAY_MS, TRANSIENT_PATTERNS


def backoff_ms(attempt: Column, seed: Column, base_ms: int = RETRY_BASE_DELAY_MS,
               cap_ms: int = RETRY_MAX_DELAY_MS) -> Column:
    """Capped exponential delay with jitter in [-1/8, +1/8) of the capped delay.

    The jitter comes from ``xxhash64(seed, attempt)`` instead of a clock, so a
    re-executed task computes the same schedule.
    """
    n = F.greatest(attempt.cast("long") - 1, F.lit(0))
    exp = F.lit(base_ms).cast("double") * F.pow(F.lit(2.0), n)
    capped = F.least(exp, F.lit(float(cap_ms))).cast("long")
    jitter = F.floor(capped / 4).cast("long")
    spread = F.greatest(jitter, F.lit(1))
    return capped - F.floor(jitter / 2).cast("long") + F.pmod(F.xxhash64(seed, attempt), spread)


def is_transient(message: Column, is_serialization: Column | None = None) -> Column:
    """Storage error text -> retryable? Serialization errors never are."""
    low = F.lower(message)
    hit = None
    for p in TRANSIENT_PATTERNS:
        c = low.contains(p)
        hit = c if hit is None else (hit | c)
    hit = F.coalesce(hit, F.lit(False))
    if is_serialization is not None:
        hit = ~F.coalesce(is_serialization, F.lit(False)) & hit
    return hit
