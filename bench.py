"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely into the ``noop`` sink (no driver collect)
after one warm-up run of the flagship query; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assaykit import get_spark  # noqa: E402
from assaykit.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "v_gate",               # full staged gate over all three formats
    "norm_c",               # CSV grouping + scaling, flattened scores
    "batch_outcome",        # batch explode + gate + per-submission status
    "build_envelope",       # outbox envelopes (JSON) for every assessment
    "agg_failed_backlog",   # grouping sets over the failure table
    "audit_verdict",        # three audit checks -> one verdict
    "agg_first_wins",       # first-wins dedup with map-side min_by
    "j_insert_absent",      # anti-join insert
    "ts_error_ratio",       # tumbling + sliding windows
    "ts_latency_quantile",  # histogram quantiles per window
    "ts_alert_sustained",   # alert islands
    "st_outbox_state",      # fan-out + delivery results + state transition
    "q_stale_outbox",       # top-k oldest pending
    "pii_hmac",             # native HMAC over a table column
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": "16g"})
    names = sys.argv[1:] or HEADLINE
    QUERIES["v_gate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
