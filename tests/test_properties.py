"""Properties every job keeps: partitioning does not change results, an empty tab or an absent column does not
end a job."""

import os

import pytest
from pyspark.sql import functions as F

from pulseboard.operators import distributions as DI
from pulseboard.operators import kpis as K
from pulseboard.operators import lists as L
from pulseboard.operators import scores as S
from pulseboard.operators import staffing as ST
from pulseboard.plans import catalog as cat
from pulseboard.sources import driver
from pulseboard.sources.tabs import ROW, empty_tab

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
DAY = cat.AS_OF

PROJECT = {
    "kpi_status": lambda p: K.kpi_status(p), "kpi_status_by": lambda p: K.kpi_status(p, by=("Client",)), "kpi_revenue": lambda p: K.kpi_revenue(p),
    "project_scores": lambda p: K.project_scores(p), "project_scores_by": lambda p: K.project_scores(p, by=("Client",)), "extremes": lambda p: K.project_extremes(p),
    "next_deal_gap": lambda p: K.next_deal_gap(p, DAY), "checkins": lambda p: K.kpi_checkins(p, DAY), "non_green": lambda p: L.non_green_projects(p),
    "at_risk": lambda p: L.at_risk_projects(p), "active": lambda p: L.active_projects(p, DAY), "overdue": lambda p: L.overdue_next_deal(p, DAY),
    "overdue_checkins": lambda p: L.overdue_checkins(p, DAY), "listing": lambda p: L.project_listing(p),
    "health_lookup": lambda p: S.project_health_lookup(p, driver.mapping(p.sparkSession)),
}
PIPELINE = {
    "kpi_pipeline": lambda p: K.kpi_pipeline(p), "pipeline_scores": lambda p: K.pipeline_scores(p), "extremes": lambda p: K.pipeline_extremes(p),
    "deal_cycle": lambda p: K.deal_cycle(p), "by_tier": lambda p: K.deal_cycle_by_tier(p), "listing": lambda p: L.pipeline_listing(p), "top": lambda p: L.top_pursuits(p),
}
OTHER = {
    "kpi_risk": (cat.risks, lambda r: K.kpi_risk(r), "Project Risks"), "by_severity": (cat.risks, lambda r: DI.risk_by_severity(r), "Project Risks"),
    "utilization": (cat.staff, lambda s: K.kpi_utilization(s), "Team Utilization"), "ranking": (cat.staff, lambda s: L.utilization_ranking(s), "Team Utilization"),
    "exec_cost": (cat.activity, lambda a: K.kpi_exec_cost(a), "Executive Activity"),
}
JOBS = [(f"project {n}", cat.projects, f, "Project Inventory") for n, f in PROJECT.items()] + \
    [(f"pipeline {n}", cat.pipeline, f, "Pipeline") for n, f in PIPELINE.items()] + [(n, *x) for n, x in OTHER.items()]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name,tab,job,_", JOBS, ids=[j[0] for j in JOBS])
def test_partitioning_does_not_change_results(spark, name, tab, job, _):
    t = tab(spark, SF)
    want = rows(job(t.repartition(1)))
    assert rows(job(t.repartition(7))) == want and rows(job(t.repartition(64))) == want


@pytest.mark.parametrize("name,_,job,tab", JOBS, ids=[j[0] for j in JOBS])
def test_empty_tab(spark, name, _, job, tab):
    out = job(empty_tab(spark, tab)).collect()
    for r in out:  # a KPI row holds numbers and N/A, never null
        assert all(v is not None for v in r)


@pytest.mark.parametrize("name,tab,job,_", JOBS, ids=[j[0] for j in JOBS])
def test_absent_columns(spark, name, tab, job, _):
    t = tab(spark, SF)
    for c in t.columns:
        if c not in (ROW, "Client"):
            assert job(t.drop(c)).schema is not None
    bare = t.limit(20).select(ROW, *(["Client"] if "Client" in t.columns else []))
    job(bare).collect()


def test_staffing_holds_under_partitioning_and_without_staff(spark):
    p, s = cat.projects(spark, SF), cat.staff(spark, SF)
    want = rows(ST.staffing_health(p, s, DAY))
    assert rows(ST.staffing_health(p.repartition(7), s.repartition(5), DAY)) == want
    alone = ST.staffing_health(p, empty_tab(spark, "Team Utilization"), DAY)
    assert alone.count() == len(want) and alone.where(F.col("Assigned Team Size") > 0).count() == 0


def test_snapshot_caps_are_arguments(spark):
    from pulseboard.operators import report as R

    tabs = [("Talent Gaps", cat.talent_gaps(spark, SF))]
    n = tabs[0][1].count()
    few = R.context_snapshot(tabs, caps=(("Talent Gaps", 3),)).orderBy("line_no").collect()
    assert [r.line_no for r in few] == [0, 1, 2, 3, 4, 5] and few[-1].text == f"... (showing top 3 of {n} rows)"
    whole = R.context_snapshot([(tabs[0][0], tabs[0][1].repartition(5))], default=None).orderBy("line_no").collect()
    assert [r.line_no for r in whole] == list(range(n + 2)) and [r.text for r in whole[:5]] == [r.text for r in few[:5]]
    ordered = [R_.text for R_ in whole[2:]]
    assert ordered == [r.text for r in tabs[0][1].orderBy(ROW).select(R.row_text(tabs[0][1]).alias("text")).collect()]
