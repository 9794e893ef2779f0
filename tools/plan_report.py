"""Plan shape of every registered query (physical plan after planning, before
adaptive re-optimisation): shuffles, join strategies, windows and group limits,
pushed scan filters. Writes PLANS.md.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opslens import catalog  # noqa: E402
from opslens.plans.inspect import physical_plan  # noqa: E402
from opslens.session import local_session  # noqa: E402


def shape(plan: str) -> dict:
    nodes = re.findall(r"^\(\d+\) (\w+)", plan, re.MULTILINE)
    pushed = [p for p in re.findall(r"PushedFilters: \[(.*)\]", plan) if p.strip()]
    interesting = [p for p in pushed if not all(x.startswith("IsNotNull") for x in p.split(", "))]
    return {
        "shuffles": sum(1 for n in nodes if n == "Exchange"),
        "broadcasts": sum(1 for n in nodes if n == "BroadcastExchange"),
        "bhj": sum(1 for n in nodes if n == "BroadcastHashJoin"),
        "smj": sum(1 for n in nodes if n == "SortMergeJoin"),
        "hash_agg": sum(1 for n in nodes if n == "HashAggregate"),
        "windows": sum(1 for n in nodes if n == "Window"),
        "group_limits": sum(1 for n in nodes if n == "WindowGroupLimit"),
        "top_k": sum(1 for n in nodes if n == "TakeOrderedAndProject"),
        "scans": sum(1 for n in nodes if n == "Scan"),
        "pushed": len(interesting),
        "python": sum(1 for n in nodes if "Python" in n or "ArrowEval" in n or "FlatMapGroups" in n),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8)
    cols = ["shuffles", "broadcasts", "bhj", "smj", "hash_agg", "windows", "group_limits", "top_k",
            "scans", "pushed", "python"]
    lines = ["# PLANS", "",
             f"Physical plan shape of every report query on `{sf_dir}` (`local[8]`, before AQE",
             "re-optimisation; AQE may still turn a sort-merge join into a broadcast or coalesce",
             "partitions at run time). `pushed` counts scans with a pushed filter beyond IS NOT NULL.",
             "Generated by `tools/plan_report.py`.", "",
             "| query | " + " | ".join(cols) + " |", "| --- |" + " --- |" * len(cols)]
    for name in catalog.QUERIES:
        s = shape(physical_plan(catalog.spark_query(name)(spark, sf_dir)))
        lines.append(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print(out)


if __name__ == "__main__":
    main()
