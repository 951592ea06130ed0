"""Audit and metric aggregates.

All of them have a partial (map-side) phase, so a hot label value is
pre-combined in every task before the shuffle and never lands whole on one
reducer. Counts and histograms are hash aggregates; ``first_wins`` carries whole
rows and is planned as a sort aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assaykit.schemas import (
    FAILED_RECORDS_CRITICAL, OUTBOX_FAILED, OUTBOX_PENDING, OUTBOX_PENDING_WARN,
    VIOLATIONS_LOOKBACK_HOURS,
)


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def grouped_counts(df: DataFrame, dims: Sequence[str], count_name: str = "n") -> DataFrame:
    """Counts for the total and for each dimension alone, in one pass.

    ``GROUPING SETS ((), (d1), (d2), ...)`` -> rows ``(grouping, key, n)``
    where ``grouping`` names the dimension (``total`` for the grand total).
    """
    view = df.select(*[F.col(d).cast("string").alias(d) for d in dims])
    sets = [[]] + [[d] for d in dims]
    agg = view.groupingSets(sets, *dims).agg(
        F.count("*").alias(count_name), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    level = F.lit("total")
    key = F.lit(None).cast("string")
    for d in reversed(dims):
        level = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(level)
        key = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(key)
    return agg.select(level.alias("grouping"), key.alias("key"), count_name)


def failed_backlog(failed: DataFrame) -> DataFrame:
    """Unreplayed failures: total, by provider, by error kind."""
    return grouped_counts(failed.filter(~F.col("replayed")), ["provider", "error_kind"])


def violations_recent(violations: DataFrame, as_of: Column,
                      hours: int = VIOLATIONS_LOOKBACK_HOURS) -> DataFrame:
    """Violation rows with ``created_at >= as_of - hours``: total, by boundary, by provider."""
    recent = violations.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return grouped_counts(recent, ["boundary", "provider"])


def outbox_status(outbox: DataFrame) -> DataFrame:
    """Pending and failed counts in one scan."""
    return outbox.agg(
        F.count_if(F.col("status") == OUTBOX_PENDING).alias("pending"),
        F.count_if(F.col("status") == OUTBOX_FAILED).alias("failed"),
    )


def audit_verdict(failed_unreplayed: Column, violations_recent_n: Column,
                  outbox_pending: Column, outbox_failed: Column) -> dict[str, Column]:
    """Severity of the three checks and the process exit code (0 ok, 1 critical)."""
    critical = (failed_unreplayed >= FAILED_RECORDS_CRITICAL) | (outbox_failed > 0)
    warn = ((failed_unreplayed > 0) | (violations_recent_n > 0) | (outbox_pending >= OUTBOX_PENDING_WARN))
    return {
        "failed_check": F.when(failed_unreplayed >= FAILED_RECORDS_CRITICAL, "critical")
                         .when(failed_unreplayed > 0, "warning").otherwise("ok"),
        "violations_check": F.when(violations_recent_n > 0, "warning").otherwise("ok"),
        "outbox_check": F.when(outbox_failed > 0, "critical")
                         .when(outbox_pending >= OUTBOX_PENDING_WARN, "warning").otherwise("ok"),
        "verdict": F.when(critical, "critical").when(warn, "warning").otherwise("ok"),
        "exit_code": F.when(critical, 1).otherwise(0),
    }


def violations_by_boundary(violation_events: DataFrame, keys: Sequence[str],
                           boundaries: Sequence[str] = ("pre_transform", "post_transform")) -> DataFrame:
    """Split each failure's tagged violations by boundary (one row per boundary present).

    Runs inside each row with ``filter`` per boundary: no shuffle, and the
    violations keep their order.
    """
    def on(b):
        return lambda x: x["boundary"] == F.lit(b)

    groups = F.array(*[F.struct(F.lit(b).alias("boundary"), F.filter("violations", on(b)).alias("v"))
                       for b in boundaries])
    per = violation_events.select(*keys, F.explode(groups).alias("g")).filter(F.size("g.v") > 0)
    return per.select(*keys, F.col("g.boundary").alias("boundary"),
                      F.transform("g.v", lambda x: F.struct(x["field"].alias("field"), x["expected"].alias("expected"),
                                                            x["actual"].alias("actual"), x["message"].alias("message")))
                      .alias("violations"),
                      F.size("g.v").alias("n_violations"))


def counters(df: DataFrame, labels: Sequence[str], name: str = "n") -> DataFrame:
    """Event counts by a label set (one generic counter)."""
    return df.groupBy(*labels).agg(F.count("*").alias(name))


def bucket_label(b: float) -> str:
    return repr(float(b))


def histogram_wide(df: DataFrame, value: Column, bounds: Sequence[float],
                   by: Sequence[str | Column] = ()) -> DataFrame:
    """Cumulative bucket counts as one aggregate row per group.

    ``counts`` is an array with ``count_if(v <= le)`` for each bound then the
    +Inf total; the aggregate is partial+final, so the shuffle carries one
    small row per (task, group).
    """
    aggs = [F.count_if(value <= F.lit(float(b))) for b in bounds] + [F.count(value)]
    return df.groupBy(*_cols(by)).agg(F.array(*aggs).alias("counts"), F.sum(value).alias("sum"))


def histogram(df: DataFrame, value: Column, bounds: Sequence[float],
              by: Sequence[str | Column] = ()) -> DataFrame:
    """Long form ``(by..., le, bucket_count)`` with ``le`` labels and ``+Inf``."""
    wide = histogram_wide(df, value, bounds, by)
    labels = F.array(*[F.lit(bucket_label(b)) for b in bounds] + [F.lit("+Inf")])
    names = [c if isinstance(c, str) else None for c in by]
    keep = [n for n in names if n]
    return wide.select(*keep, F.posexplode(F.arrays_zip(labels.alias("le"), F.col("counts").alias("c")))
                       .alias("bucket_index", "z")).select(
        *keep, "bucket_index", F.col("z.le").alias("le"), F.col("z.c").alias("bucket_count"))


def quantile_from_counts(counts: Column, bounds: Sequence[float], q: float) -> Column:
    """Histogram quantile with linear interpolation inside the bucket.

    The first bucket starts at 0; a rank in the +Inf bucket returns the
    largest finite bound; an empty histogram gives NULL.
    """
    n = len(bounds)
    b = F.array(*[F.lit(float(x)) for x in bounds])
    total = F.element_at(counts, n + 1)
    rank = F.lit(float(q)) * total
    # first 1-based position whose cumulative count reaches the rank
    idx = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    upper = F.when(idx <= n, F.element_at(b, F.greatest(idx, F.lit(1))))
    lower = F.when(idx > 1, F.element_at(b, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0.0))
    c_hi = F.element_at(counts, F.greatest(idx, F.lit(1))).cast("double")
    c_lo = F.when(idx > 1, F.element_at(counts, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0)).cast("double")
    interp = lower + (upper - lower) * (rank - c_lo) / F.when(c_hi > c_lo, c_hi - c_lo)
    interp = F.coalesce(interp, upper)
    return (F.when(total == 0, F.lit(None).cast("double"))
            .when(idx > n, F.lit(float(bounds[-1])))
            .otherwise(interp))


def histogram_quantiles(df: DataFrame, value: Column, bounds: Sequence[float],
                        by: Sequence[str | Column] = (), qs=(0.5, 0.95, 0.99)) -> DataFrame:
    wide = histogram_wide(df, value, bounds, by)
    keep = [c for c in wide.columns if c not in ("counts", "sum")]
    return wide.select(*keep, F.element_at("counts", len(bounds) + 1).alias("n"),
                       *[quantile_from_counts(F.col("counts"), bounds, q).alias(f"p{int(q * 100)}") for q in qs])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key by ``order`` (ON CONFLICT DO NOTHING).

    ``min_by`` over a struct is an ordinary aggregate with a map-side phase,
    so a key holding a large share of the rows is reduced inside each task
    before anything is shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_w"))
    return picked.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])


def batch_summary(gate: DataFrame) -> DataFrame:
    """Per submission: items, successes, errors, assessments and the status 200 / 207 / 400.

    ``gate`` carries ``submission_id``, ``item_index`` and ``batch_ok`` from ``explode_batch``: a
    submission without items has one row with a null index, and a body that
    is not an array of items (``batch_ok`` false) is a 400.
    """
    item, ok = F.col("item_index").isNotNull(), F.col("stage") == "ok"
    agg = gate.groupBy("submission_id").agg(
        F.count("item_index").alias("n_items"), F.count_if(item & ok).alias("n_succeeded"),
        F.count_if(item & ~ok).alias("n_failed"),
        F.sum(F.when(item & ok, F.size("assessments")).otherwise(0)).alias("n_assessments"),
        F.bool_and("batch_ok").alias("_ok"))
    status = (F.when(~F.col("_ok"), 400).when(F.col("n_failed") == 0, 200)
              .when(F.col("n_assessments") == 0, 400).otherwise(207))
    return agg.withColumn("status", status).drop("_ok")
