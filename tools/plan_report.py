"""Summarise the physical plan of every registered query (writes PLANS.md).

For each key: shuffles (Exchange), broadcasts, join strategies, sort-based
aggregates, windows, Python evaluation, and the columns each scan reads.
Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    tree = plan.split("\n\n")[0]
    count = lambda pat: len(re.findall(pat, tree))
    scans = re.findall(r"\(\d+\) Scan (\w+)[^\n]*\n(?:[^\n]*\n)*?ReadSchema: (struct<[^\n]*>)", plan)
    return {
        "shuffles": count(r"\bExchange \("),
        "broadcasts": count(r"BroadcastExchange \("),
        "bhj": count(r"BroadcastHashJoin"),
        "smj": count(r"SortMergeJoin"),
        "bnlj": count(r"BroadcastNestedLoopJoin|CartesianProduct"),
        "sort_agg": count(r"SortAggregate"),
        "window": count(r"\bWindow \("),
        "python": count(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas"),
        "scans": [f"{kind}: {schema[:110]}" for kind, schema in scans],
    }


def main(sf_dir: str) -> None:
    from insight import build_session
    from insight.plans.registry import QUERIES, load_all

    spark = build_session()
    load_all()
    lines = ["# PLANS", "",
             f"Physical plans of the registered queries at `{sf_dir}` (static plans before AQE; AQE may still turn",
             "a shuffle join into a broadcast join or coalesce partitions at runtime). Generated by",
             "`tools/plan_report.py`. A branch that appears twice (self-joins of one staged table) is counted twice",
             "although Spark reuses the exchange at runtime. Queries that first write a landing table or fit a model",
             "show the plan of the",
             "final read / transform only.", "",
             "| key | shuffles | broadcasts | BHJ | SMJ | nested-loop | sort-agg | window | python |",
             "|---|---|---|---|---|---|---|---|---|"]
    scans = {}
    for key in sorted(QUERIES):
        buf = io.StringIO()
        with redirect_stdout(buf):
            QUERIES[key](spark, sf_dir).explain("formatted")
        s = summarise(buf.getvalue())
        scans[key] = s["scans"]
        lines.append(f"| {key} | {s['shuffles']} | {s['broadcasts']} | {s['bhj']} | {s['smj']} | {s['bnlj']} | "
                     f"{s['sort_agg']} | {s['window']} | {s['python']} |")
    lines += ["", "## Columns read per scan", ""]
    for key, sc in scans.items():
        lines.append(f"* `{key}`: " + "; ".join(f"`{x}`" for x in sc))
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
