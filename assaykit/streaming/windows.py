"""Rates, ratios and alert rules while events arrive.

* :func:`start_window_counts` keeps totals and errors of event-time windows by label. Every
  micro-batch stores the windows it changed under its own commit; :func:`window_counts` is
  their latest state, so windows that are still open are there too. Rows later than the
  watermark are dropped by Spark and counted: :func:`late_rows`.
* :func:`firing_islands` is the ``for:`` of alert rules as state with a timer for each rule:
  an unbroken firing time grows while its samples arrive a step apart; when the watermark
  passes a step without one, the timer ends it. Rules share no state, and a rule's state is
  three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assaykit.plans.store import TableStore


def start_window_counts(events: DataFrame, store: TableStore, checkpoint: str, ts: str, is_error: Column,
                        labels: Sequence[str] = (), length: str = "5 minutes", slide: str | None = None,
                        late_after: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """Count events and errors per window and label set (``ts``: UTC wall clock) into the table ``window_counts``."""
    at = F.col(ts).cast("timestamp")
    w = F.window("_at", length, slide) if slide else F.window("_at", length)
    counted = (events.withColumn("_at", at).withWatermark("_at", late_after).groupBy(w.alias("w"), *labels)
               .agg(F.count("*").alias("total"), F.count_if(is_error).alias("errors"))
               .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *labels, "total", "errors"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.as_writer("windows").write_plain_batch(
            {"window_counts": batch.withColumn("batch", F.lit(batch_id).cast("long"))}, batch_id)

    q = counted.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def window_counts(store: TableStore, labels: Sequence[str] = ()) -> DataFrame:
    """(window_start, labels, total, errors): each window as its last micro-batch left it."""
    last = F.max_by(F.struct("total", "errors"), "batch").alias("last")
    return (store.read("window_counts").groupBy("window_start", *labels).agg(last)
            .select("window_start", *labels, "last.total", "last.errors"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress reports that the session still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


ISLANDS = ("rule string, island_start timestamp, island_last timestamp, samples long, duration_seconds long, "
           "active_from timestamp")
STATE = "start_us long, last_us long, samples long"


def _rule_fold(step_us: int):
    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()              # a step went by without a firing sample
            return
        rows = pd.concat(list(frames)).sort_values("at_us", kind="stable")
        rows = rows[rows["firing"].astype(bool)]
        island, found = list(state.get) if state.exists else None, {}
        wait = int(rows["for_seconds"].iloc[0]) if len(rows) else 0
        for at in rows["at_us"].tolist():
            if island is None or at - island[1] > step_us:
                island = [at, at, 0]
            island[1], island[2] = max(at, island[1]), island[2] + 1
            if island[1] - island[0] >= wait * 1_000_000:
                found[island[0]] = tuple(island)
        if island is not None:
            state.update(tuple(island))
            state.setTimeoutTimestamp(max((island[1] + step_us) // 1000, state.getCurrentWatermarkMs()) + 1)

        def utc(us):
            return pd.to_datetime(us, unit="us")

        if found:
            yield pd.DataFrame([(key[0], utc(a), utc(b), n, (b - a) // 1_000_000, utc(a + wait * 1_000_000))
                                for a, b, n in found.values()],
                               columns=["rule", "island_start", "island_last", "samples", "duration_seconds", "active_from"])
    return fold


def firing_islands(evaluated: DataFrame, step_seconds: int, late_after: str = "10 minutes") -> DataFrame:
    """Stream of evaluated samples (rule, window_start, firing, for_seconds) to the firing times that are long enough.

    A firing time is given once it has lasted ``for_seconds`` and again whenever it grows: the row with the most
    samples of a (rule, island_start) is its state. Samples of a rule must arrive in time order over micro-batches.
    """
    at = F.col("window_start").cast("timestamp")
    rows = evaluated.select("rule", at.alias("at"), "firing", "for_seconds", F.unix_micros(at).alias("at_us"))
    return rows.withWatermark("at", late_after).groupBy("rule").applyInPandasWithState(
        _rule_fold(step_seconds * 1_000_000), ISLANDS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
