"""Write PLANS.md: the executed (AQE final) plan shape of every registered query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md

Per query: input rows read (task input metrics from an event log in a scratch
folder), exchanges by kind, join strategies, window group limits, and whether
filters were pushed into a scan.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsmetrics.plans.catalog import catalog  # noqa: E402
from opsmetrics import build_session  # noqa: E402
from opsmetrics.functions.expr import PY_WHITESPACE  # noqa: E402

PATTERNS = {
    "hash": r"Exchange hashpartitioning",
    "range": r"Exchange rangepartitioning",
    "single": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "reused": r"Reused(Exchange|Subquery)",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "SHJ": r"ShuffledHashJoin",
    "BNLJ": r"BroadcastNestedLoopJoin",
    "group-limit": r"WindowGroupLimit .*Partial",
    "top-k": r"TakeOrderedAndProject",
}


def final_sections(plan: str) -> str:
    plan = plan.replace(PY_WHITESPACE, "<ws>")
    keep, skip_at = [], None
    for line in plan.split("\n"):
        m = re.search(r"[^ :|+\-]", line)
        pos = m.start() if m else len(line)
        if skip_at is not None:
            if pos > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = line.index("==") - 1
            continue
        keep.append(line)
    return "\n".join(keep)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    logdir = tempfile.mkdtemp(prefix="opsmetrics-plans-")
    spark = build_session(
        "local[8]",
        shuffle_partitions=8,
        extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir, "spark.eventLog.compress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    shapes = {}
    for name, query in catalog().items():
        build = query.build
        spark.sparkContext.setJobGroup(name, name)
        df = build(spark, sf_dir)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # runs this query execution, so its AQE plan is final
        plan = final_sections(qe.executedPlan().toString())
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        pushed = bool(re.search(r"PushedFilters: \[[^\]]", plan))
        shapes[name] = (counts, pushed)
    spark.stop()
    group_of, rows_read = {}, {}
    for f in sorted(glob.glob(logdir + "/**/events_*", recursive=True)) + sorted(glob.glob(logdir + "/*")):
        if os.path.isdir(f):
            continue
        for line in open(f):
            try:
                ev = json.loads(line)
            except ValueError:
                continue
            if ev["Event"] == "SparkListenerJobStart":
                g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for s in ev["Stage IDs"]:
                    group_of[s] = g
            elif ev["Event"] == "SparkListenerTaskEnd":
                g = group_of.get(ev["Stage ID"])
                rows = ((ev.get("Task Metrics") or {}).get("Input Metrics") or {}).get("Records Read", 0)
                rows_read[g] = rows_read.get(g, 0) + rows
    cols = list(PATTERNS)
    print("# PLANS\n")
    print(f"Executed plan shape of every registered query at `{sf_dir}` on `local[8]` (AQE final plans,")
    print("generated by `tools/plan_report.py`). Input rows: rows read from parquet by all tasks")
    print("of the query, including the main plan and its subqueries. Exchanges: shuffles by partitioning kind.")
    print("Joins: the strategy AQE chose. group-limit: partial `WindowGroupLimit` before a shuffle.")
    print("pushed: a filter reached a parquet scan.\n")
    print("| query | input rows | " + " | ".join(cols) + " | pushed |")
    print("| --- | ---: | " + " | ".join("---:" for _ in cols) + " | --- |")
    for name, (counts, pushed) in shapes.items():
        cells = " | ".join(str(counts[c]) if counts[c] else "" for c in cols)
        print(f"| `{name}` | {rows_read.get(name, 0):,} | {cells} | {'yes' if pushed else ''} |")


if __name__ == "__main__":
    main()
