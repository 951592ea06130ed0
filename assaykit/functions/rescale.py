"""Linear score rescaling with clamping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assaykit.schemas import SCALE_PRESETS


def rescale(value: Column, in_min: float, in_max: float,
            out_min: float = 0.0, out_max: float = 100.0) -> Column:
    """out_min + (clamp(v) - in_min) / (in_max - in_min) * (out_max - out_min).

    Out-of-range inputs clamp to the range ends (unlike the fixed x10
    providers, which leave them for the range check to reject).
    """
    if in_max <= in_min:
        raise ValueError("empty input range")
    clamped = F.least(F.greatest(value.cast("double"), F.lit(float(in_min))), F.lit(float(in_max)))
    return (F.lit(float(out_min))
            + (clamped - F.lit(float(in_min))) / F.lit(float(in_max - in_min))
            * F.lit(float(out_max - out_min)))


def rescale_preset(value: Column, preset: str) -> Column:
    lo, hi = SCALE_PRESETS[preset]
    return rescale(value, lo, hi)
