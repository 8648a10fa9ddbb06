"""KPI state per file: equal to the bundle after adding, changing and removing files; unchanged files unread."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import tab
from pulseboard.operators import kpis as K
from pulseboard.operators import state as S

D = dt.date(2025, 6, 30)


def rows(n, seed):
    day = lambda k: (D + dt.timedelta(days=k)).isoformat()
    out = []
    for i in range(n):
        k = (i * 7919 + seed * 104729) % 1013
        out.append({"Project Name": f"p{seed}-{i}", "Status (R/Y/G)": "RYG"[k % 3], "Revenue": ["$1,000.50", "4e-11", "1" * 25, "-3"][k % 4],
                    "Project Health Score": str(k % 101), "Total Project Score": str(k % 97 / 7), "eNPS": str(k % 60), "Project End Date": day(k % 200 - 150),
                    "Next Opp First Discussion Date": day(k % 90) if k % 2 else None, "Last Sponsor Checkin Date": day(-(k % 60)) if k % 5 else None})
    return out


FRAME, FAMILIES = K.BUNDLE["projects"]


def families(df):
    return FAMILIES(df, D, K.DEFAULT_TARGETS)


def write(spark, folder, name, data, first):
    df = tab(spark, "Project Inventory", data).withColumn("_row", F.col("_row") + first)
    tmp = f"{folder}-tmp-{name}"
    df.coalesce(1).write.mode("overwrite").parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    part = glob.glob(f"{tmp}/part-*.parquet")[0]
    shutil.copy(part, f"{folder}/{name}.parquet")


def same(spark, folder, state):
    df = spark.read.parquet(folder)
    want = K.run(FRAME(df), families(FRAME(df))).first()
    got = S.merged(spark, folder, state, FRAME, families, df.schema).first()
    assert got.asDict() == want.asDict()


@pytest.fixture
def place(spark, tmp_path):
    folder, state = str(tmp_path / "in put%20+"), str(tmp_path / "state")
    for k in range(4):
        write(spark, folder, f"f{k}", rows(60, k), 1000 * k)
    return folder, state


def test_refresh_reads_only_what_changed(spark, place):
    folder, state = place
    with pytest.raises(ValueError, match="no state"):
        S.merged(spark, folder, state, FRAME, families, spark.read.parquet(folder).schema)
    assert len(S.refresh(spark, folder, state, FRAME, families)) == 4
    same(spark, folder, state)
    assert S.refresh(spark, folder, state, FRAME, families) == []
    write(spark, folder, "f9", rows(25, 9), 9000)  # added
    write(spark, folder, "f1", rows(61, 77), 1000)  # changed
    os.remove(f"{folder}/f2.parquet")  # removed
    read = S.refresh(spark, folder, state, FRAME, families)
    assert sorted(os.path.basename(p) for p in read) == ["f1.parquet", "f9.parquet"]
    same(spark, folder, state)
    os.remove(f"{folder}/f9.parquet")  # nothing to read: its state no longer takes part
    assert S.refresh(spark, folder, state, FRAME, families) == []
    same(spark, folder, state)


def test_a_refresh_that_died_is_run_again(spark, place):
    folder, state = place
    S.refresh(spark, folder, state, FRAME, families)
    write(spark, folder, "f3", rows(10, 5), 3000)
    for part in glob.glob(f"{state}/facts/*")[:2]:  # counts and cells were written, the mark was not
        shutil.rmtree(part) if os.path.isdir(part) else None
    S.refresh(spark, folder, state, FRAME, families)
    same(spark, folder, state)


def test_files_without_rows(spark, place):
    folder, state = place
    write(spark, folder, "empty", [], 0)
    assert len(S.refresh(spark, folder, state, FRAME, families)) == 5
    assert S.refresh(spark, folder, state, FRAME, families) == []
    same(spark, folder, state)


def test_rows_without_cells_in_parts_are_not_read_for_them(spark, tmp_path, monkeypatch):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    near = [dict(r, **{"Revenue": "$1,000.50", "Total Project Score": "1.25"}) for r in rows(30, 1)]
    write(spark, folder, "a", near, 0)
    read = []
    cells = S.exact.cells
    monkeypatch.setattr(S.exact, "cells", lambda df, keys, n: read.append(sorted(os.path.basename(p) for p in df.inputFiles())) or cells(df, keys, n))
    S.refresh(spark, folder, state, FRAME, families)
    assert read == []
    same(spark, folder, state)
    read.clear()  # the whole bundle, worked out anew, looks for them in all rows
    write(spark, folder, "b", rows(30, 2), 1000)
    write(spark, folder, "c", [dict(r, **{"Project Name": f"c{i}"}) for i, r in enumerate(near)], 2000)
    assert len(S.refresh(spark, folder, state, FRAME, families)) == 2
    assert read == [["b.parquet"]]
    same(spark, folder, state)
    assert sorted(os.listdir(state)) == ["cells", "counts", "facts"]  # nothing is left of the work


def test_no_row_is_sorted_to_be_grouped_by_its_file(spark):
    df = FRAME(tab(spark, "Project Inventory", rows(5, 1)))
    bests = [a for f in families(df) for a in f.aggs if isinstance(a, S.Best)]
    plan = df.groupBy("Client").agg(*[b.first() for b in bests])._jdf.queryExecution().executedPlan().toString()
    assert len(bests) == 4 and "HashAggregate" in plan and "SortAggregate" not in plan


def test_extremes_with_ties_and_without_scores(spark, tmp_path):
    """Typed columns come as they are stored: a missing score stands before all others, in every file."""
    frame, fams = K.BUNDLE["pipeline"]
    of = lambda df: fams(df, D, K.DEFAULT_TARGETS)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    data = [{"Account": f"a{i}", "Opportunity Created Date": "2025-01-01", "Closed Won Date": "2025-01-09", "Pipeline Score": str(i % 3), "Total Deal Score": "-0" if i % 2 else "0"} for i in range(12)]
    t = frame(tab(spark, "Pipeline", data))
    t = t.withColumn("__pscore", F.when(F.col("_row") != 7, F.col("__pscore"))).withColumn("__tscore", F.when(F.col("_row") % 5 != 4, F.col("__tscore")))
    for k in range(3):
        t.where(F.col("_row") % 3 == k).coalesce(1).write.parquet(f"{folder}/{k}")
    assert len(S.refresh(spark, folder, state, frame, of, t.schema)) == 3
    df = spark.read.schema(t.schema).option("recursiveFileLookup", "true").parquet(folder)
    assert S.merged(spark, folder, state, frame, of, t.schema).first() == K.run(df, of(df)).first()


def test_the_refresh_maps_project_inventory_once_per_write(spark, tmp_path, monkeypatch):
    from pulseboard.plans import catalog as cat
    from test_mapped import lines, orders

    orders(spark, tmp_path)
    sf = lines(spark, tmp_path)
    spark.createDataFrame([(k, k % 3, "call", 1.5 * k) for k in range(9)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{sf}/events.parquet")
    for name in ("stored_projects", "filed_projects"):
        monkeypatch.setattr(cat, name, lambda *a: pytest.fail("Project Inventory is written as files before it is written as files"))
    assert cat.QUERIES["kpi_refresh"](spark, sf).collect() == cat.QUERIES["kpi_all"](spark, sf).collect()
