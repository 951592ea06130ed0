"""Summarize the physical plan of every registered query (no execution).

Counts shuffles, broadcasts, reused exchanges, sort-merge joins, Python
nodes, generators, top-k nodes, and whether scans received pushed filters.
Writes a Markdown table to stdout.
Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assaykit import get_spark  # noqa: E402
from assaykit.plans.catalog import QUERIES  # noqa: E402

# queries that write to the store or run a stream while being built
SIDE_EFFECTS = {"sink_envelopes", "sink_errors", "st_dedup_window", "stream_payloads", "st_sweep",
                "scan_assessments", "sink_json"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 16)
    print("| query | shuffles | broadcasts | reused | SMJ | BHJ | python | generate | top-k | pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if name in SIDE_EFFECTS:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = lambda p: len(re.findall(p, plan))
        pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", plan))
        print(f"| {name} | {c('Exchange hashpartitioning|Exchange RoundRobin|Exchange SinglePartition|Exchange rangepartitioning')} "
              f"| {c('BroadcastExchange')} | {c('ReusedExchange')} | {c('SortMergeJoin')} | {c('BroadcastHashJoin|BroadcastNestedLoopJoin')} "
              f"| {c('ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF')} "
              f"| {c('Generate ')} | {c('TakeOrderedAndProject')} | {pushed} |")


if __name__ == "__main__":
    main()
