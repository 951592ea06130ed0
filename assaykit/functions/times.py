"""Timestamps as UTC wall-clock ``TIMESTAMP_NTZ``.

The driver tables store zone-free timestamps meaning UTC. Everything the
engine derives (ingest time, payload dates, CSV dates, envelope dates) is
brought to the same representation, so results do not depend on the session
time zone of whoever runs the job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def utc_ntz_sql(instant: str) -> str:
    """SQL: an instant (session-zone ``TIMESTAMP``) as UTC wall-clock ``TIMESTAMP_NTZ``."""
    return f"convert_timezone(current_timezone(), 'UTC', CAST({instant} AS timestamp_ntz))"


def utc_ntz(col: Column, dtype: T.DataType | None = None) -> Column:
    """Column form; a column that already is ``TIMESTAMP_NTZ`` is kept as is."""
    if isinstance(dtype, T.TimestampNTZType):
        return col
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))


def now_utc() -> Column:
    return utc_ntz(F.current_timestamp())


def epoch_micros(col: Column, dtype: T.DataType | None = None) -> Column:
    """Microseconds since the epoch of a UTC wall-clock NTZ (or an instant)."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), col.cast("timestamp_ntz")).cast("timestamp")
    return F.unix_micros(instant)
