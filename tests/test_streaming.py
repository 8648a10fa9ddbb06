"""Streaming refresh: KPIs per snapshot, complete even when a snapshot arrives in two batches."""

import datetime as dt
import os

from conftest import tab

from pulseboard.streaming.refresh import SNAPSHOT, start_refresh


def _write(spark, root, name, snap, statuses):
    rows = [{"Project Name": f"{snap}-{i}", "Status (R/Y/G)": s, "Revenue": "$100"} for i, s in enumerate(statuses)]
    tab(spark, "Project Inventory", rows).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "stage", name))
    src = [f for f in os.listdir(os.path.join(root, "stage", name)) if f.endswith(".parquet")][0]
    os.makedirs(os.path.join(root, "in", f"{SNAPSHOT}={snap}"), exist_ok=True)
    os.rename(os.path.join(root, "stage", name, src), os.path.join(root, "in", f"{SNAPSHOT}={snap}", f"{name}.parquet"))


def test_refresh_per_snapshot(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(os.path.join(root, "in"))
    out, ck = os.path.join(root, "out"), os.path.join(root, "ck")
    as_of = dt.date(2025, 6, 30)
    _write(spark, root, "a", "s1", ["R", "G"])
    _write(spark, root, "b", "s2", ["G"])
    start_refresh(spark, os.path.join(root, "in"), out, ck, as_of, available_now=True).awaitTermination(120)
    got = {r[SNAPSHOT]: (r.total_projects, r.red_projects_count) for r in spark.read.parquet(out).collect()}
    assert got == {"s1": (2, 1), "s2": (1, 0)}
    _write(spark, root, "c", "s1", ["R"])  # more rows of snapshot s1 arrive later
    start_refresh(spark, os.path.join(root, "in"), out, ck, lambda: as_of, available_now=True).awaitTermination(120)
    got = {r[SNAPSHOT]: (r.total_projects, r.red_projects_count, r.total_revenue)
           for r in spark.read.parquet(out).collect()}
    assert got == {"s1": (3, 2, 300.0), "s2": (1, 0, 100.0)}
