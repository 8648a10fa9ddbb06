"""Summarise the executed (AQE final) plan of every registered query.

usage: python tools/plans.py [sf_dir] > PLANS.md

For each query: the parquet scans (columns read, pushed filters), join
strategies, number of exchanges, aggregates and top-N / window operators,
after running the query once (so AQE decisions are final).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    scans = []
    for cols, rest in re.findall(r"(?:FileScan|Scan) parquet [^\[]*\[([^\]]*)\]([^\n]*)", plan):
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", rest)
        names = [c.split("#")[0].strip() for c in cols.split(",") if c.strip()]
        shown = ", ".join(names[:4]) + (f", +{len(names) - 4}" if len(names) > 4 else "")
        scans.append((shown, len(names), pushed.group(1) if pushed and pushed.group(1) else ""))
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                       r"[^\n]*?(Inner|LeftOuter|LeftSemi|LeftAnti|Cross|FullOuter|RightOuter)?", plan)
    return {
        "scans": scans,
        "joins": sorted({f"{j} {t}".strip() for j, t in joins}),
        "exchanges": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "aggregates": len(re.findall(r"(?:Hash|ObjectHash|Sort)Aggregate", plan)),
        "topn": "TakeOrderedAndProject" in plan,
        "window": "Window" in plan,
        "python": "EvalPython" in plan,
    }


def main():
    from pulseboard.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[*]", 8, driver_memory="8g")
    from pulseboard.plans import catalog

    print(f"# Executed plans ({sf_dir}, local, AQE final plans)\n")
    print("Scans list `columns read (first names) [pushed filters]` per parquet scan; stored tabs are the")
    print("parquet copies written at ingest, driver tables are read directly only by the ingest and `margin`.\n")
    print("| Query | Scans | Joins | Exchanges | Broadcasts | Aggregates | Top-N | Window |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        scans = "<br>".join(f"{n} cols ({t})" + (f" [{p[:70]}]" if p else "") for t, n, p in s["scans"])
        print(f"| `{name}` | {scans} | {', '.join(s['joins']) or '-'} | {s['exchanges']} | {s['broadcasts']} | "
              f"{s['aggregates']} | {'yes' if s['topn'] else ''} | {'yes' if s['window'] else ''} |")


if __name__ == "__main__":
    main()
