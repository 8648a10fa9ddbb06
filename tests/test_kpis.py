"""KPI bundle semantics: bands (C2), dates (C8), ties (C9), cycles (C12), empty and missing inputs."""

import datetime as dt

from conftest import tab
from pulseboard.functions.bands import band
from pulseboard.operators import distributions as DI
from pulseboard.operators import kpis as K
from pulseboard.operators import lists as L
from pulseboard.sources.literal import literal_frame
from pulseboard.targets import PROJECT_SCORE_BANDS
from pyspark.sql import functions as F

D = dt.date(2025, 6, 30)


def iso(days):
    return (D + dt.timedelta(days=days)).isoformat()


def test_band_gaps_c2(spark):
    scores = [100, 85, 84.995, 84.99, 70, 69.995, 69.99, 0, -1, 100.01]
    df = literal_frame(spark, [(i, float(s)) for i, s in enumerate(scores)], [("i", "bigint"), ("s", "double")])
    got = [r.b for r in df.orderBy("i").select(band(F.col("s"), PROJECT_SCORE_BANDS).alias("b")).collect()]
    assert got == ["Excellent", "Excellent", "N/A", "Strong", "Strong", "N/A", "Weak", "Weak", "N/A", "N/A"]
    rows = [{"Project Name": f"p{i}", "Project Health Score": str(s)} for i, s in enumerate(scores)]
    dist = {r.band: (r.band_count, r.band_pct) for r in
            DI.project_score_bands(tab(spark, "Project Inventory", rows)).where("score_name = 'project_health_score'").collect()}
    assert dist["Excellent"][0] == 2 and dist["Strong"][0] == 2 and dist["Weak"][0] == 2 and dist["N/A"][0] == 4
    assert abs(dist["Excellent"][1] - 100 / 3) < 1e-9 and dist["N/A"][1] is None


def test_dates_c8(spark):
    rows = [
        {"Project Name": "a", "Project End Date": iso(-30), "Last Sponsor Checkin Date": iso(-30)},
        {"Project Name": "b", "Project End Date": iso(-31), "Last Sponsor Checkin Date": iso(-31)},
        {"Project Name": "c", "Project End Date": iso(0), "Last Sponsor Checkin Date": None},
        {"Project Name": "d", "Project End Date": None, "Last Sponsor Checkin Date": iso(-30), "Sponsor Checkin Notes": "ok"},
    ]
    p = tab(spark, "Project Inventory", rows)
    assert sorted(r["Project Name"] for r in L.overdue_next_deal(p, D).collect()) == ["b"]
    assert sorted(r["Project Name"] for r in L.active_projects(p, D).collect()) == ["c", "d"]
    assert sorted(r["Project Name"] for r in L.overdue_checkins(p, D).collect()) == ["c"]
    ck = K.kpi_checkins(p, D).first()
    assert ck.recent_meaningful_checkins_count == 1 and ck.overdue_sponsor_checkin_count == 1
    assert ck.recent_meaningful_checkins_pct == 50.0


def test_missing_notes_pass_unless_strict(spark):
    rows = [{"Project Name": "a", "Project End Date": None, "Last Sponsor Checkin Date": iso(0)},
            {"Project Name": "b", "Project End Date": None, "Last Sponsor Checkin Date": iso(0),
             "Sponsor Checkin Notes": "  "}]
    p = tab(spark, "Project Inventory", rows)
    assert K.kpi_checkins(p, D).first().recent_meaningful_checkins_count == 1
    assert K.kpi_checkins(p, D, strict_notes=True).first().recent_meaningful_checkins_count == 0


def test_upcoming_dates_c8(spark):
    rows = [{"Project Name": n, "Project End Date": iso(d)} for n, d in (("x", 0), ("y", 7), ("z", 8))]
    p = tab(spark, "Project Inventory", rows)
    pl = tab(spark, "Pipeline", [{"Account": "acc", "Next Touchpoint Date": iso(3)}])
    got = sorted((r.event_kind, r.name) for r in L.upcoming_dates(p, pl, D).collect())
    assert got == [("next_touchpoint", "acc"), ("project_end", "x"), ("project_end", "y")]


def test_ties_c9(spark):
    rows = [{"Project Name": f"r{i}", "Project Health Score": str(s), "Total Project Score": str(s)}
            for i, s in enumerate([5, 9, 9, 1, 1])]
    r = K.project_extremes(tab(spark, "Project Inventory", rows)).first()
    assert r.top_project_by_health_score == "r1" and r.bottom_project_by_health_score == "r3"


def test_cycle_c12(spark):
    def row(tier, days):
        return {"Account": "a", "Pursuit Tier": tier, "Opportunity Created Date": iso(0), "Closed Won Date": iso(days)}

    pl = tab(spark, "Pipeline", [row("a", 1), row("a", -2), row(None, 3), row("b", 4)])
    r = K.deal_cycle(pl).first()
    assert abs(r.avg_deal_cycle_time_days - 8 / 3) < 1e-12 and r.median_deal_cycle_time_days == 3.0
    by = {x["Pursuit Tier"]: (x.mean_days, x.median_days) for x in K.deal_cycle_by_tier(pl).collect()}
    assert by == {"a": (-0.5, -0.5), "b": (4.0, 4.0)}


def test_blank_score_counts_as_zero(spark):
    rows = [{"Project Name": "a", "Project Health Score": "10"}, {"Project Name": "b", "Project Health Score": None}]
    r = K.project_scores(tab(spark, "Project Inventory", rows)).first()
    assert r.avg_project_health_score == 5.0 and r.median_project_health_score == 5.0
    assert K.project_extremes(tab(spark, "Project Inventory", rows)).first().bottom_project_by_health_score == "b"


def test_empty_tab_gives_zeros(spark):
    empty = tab(spark, "Project Inventory", [])
    r = K.kpi_status(empty).first()
    assert r.total_projects == 0 and r.green_project_ratio == 0.0 and r.red_project_revenue == 0.0
    e = K.project_extremes(empty).first()
    assert e.top_project_by_health_score == "N/A"


def test_missing_columns_take_defaults(spark):
    p = tab(spark, "Project Inventory", [{"Project Name": "a"}], cols=["Project Name"])
    r = K.kpi_status(p).first()
    assert r.total_projects == 1 and r.red_projects_count == 0 and r.green_projects_count == 0
    s = K.project_scores(p).first()
    assert s.avg_project_health_score == 0.0
    assert K.next_deal_gap(p, D).first().overdue_next_deal_discussion_count == 0


def test_status_counts_and_by(spark):
    rows = [{"Project Name": str(i), "Client": c, "Status (R/Y/G)": s, "Revenue": v}
            for i, (c, s, v) in enumerate([("A", "R", "$10"), ("A", " r", "(5)"), ("B", "G ", "1e5"), ("B", None, None)])]
    p = tab(spark, "Project Inventory", rows)
    r = K.kpi_status(p).first()
    assert (r.total_projects, r.red_projects_count, r.green_projects_count, r.red_project_revenue) == (4, 2, 1, 15.0)
    by = {x.Client: x.red_projects_count for x in K.kpi_status(p, by=("Client",)).collect()}
    assert by == {"A": 2, "B": 0}
    assert r.red_projects_count + r.yellow_projects_count + r.green_projects_count <= r.total_projects


def test_risk_severity_labels(spark):
    rows = [{"Severity": "High", "Impact ($)": "$10"}, {"Severity": "medium", "Impact ($)": "5"},
            {"Severity": None, "Impact ($)": "1"}]
    r = tab(spark, "Project Risks", rows)
    got = {x.severity: x.total_impact for x in DI.risk_by_severity(r).collect()}
    assert got == {"High": 10.0, "Medium": 5.0, "Unknown": 1.0}
    k = K.kpi_risk(r).first()
    assert k.high_severity_risk_count == 1 and abs(k.high_risk_impact_as_pct_of_total - 62.5) < 1e-12


def test_medians_equal_exact(spark):
    from pulseboard.functions.stats import medians

    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(((F.col("id") * 7919) % 1013 / 3.0 - 100).alias("v"), (F.col("id") % 3).alias("g"))
        for d in (df, df.repartition(7)):
            assert medians(d, {"m": F.col("v")}).first().m == df.agg(F.round(F.median("v"), 9)).first()[0]
            got = {r.g: r.m for r in medians(d, {"m": F.col("v"), "w": F.col("v") * 2}, ("g",)).collect()}
            assert got == {r[0]: r[1] for r in df.groupBy("g").agg(F.round(F.median("v"), 9)).collect()}
    dup = spark.range(100).select(F.when(F.col("id") < 60, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("v"))
    assert medians(dup, {"m": F.col("v")}).first().m == 5.0
    assert medians(dup.limit(0), {"m": F.col("v")}).first().m is None


def test_no_percentile_in_one_task(spark):
    p = tab(spark, "Project Inventory", [{"Project Name": str(i), "Project Health Score": str(i)} for i in range(101)])
    df = K.project_scores(p)
    assert df.first().median_project_health_score == 50.0
    assert "percentile" not in df._jdf.queryExecution().executedPlan().toString()
    by = K.project_scores(p.withColumn("Client", F.when(F.col("_row") < 50, F.lit("a"))), by=("Client",))
    assert {r.Client: r.median_project_health_score for r in by.collect()} == {"a": 24.5, None: 75.0}


def test_sums_are_not_cut_to_cents_and_no_cell_ends_the_job(spark):
    p = tab(spark, "Project Inventory", [{"Project Name": "p", "Revenue": "0.004", "Status (R/Y/G)": "R\t"} for _ in range(1000)])
    assert K.kpi_revenue(p).first().total_revenue == 4.0
    assert K.kpi_status(p).first().red_project_revenue == 4.0
    big = tab(spark, "Project Inventory", [{"Project Name": "p", "Revenue": "1" * 30, "Project Health Score": "1" * 30}, {"Project Name": "q", "Revenue": "5"}])
    assert K.kpi_revenue(big).first().total_revenue == float("1" * 30) + 5
    assert K.project_scores(big).first().avg_project_health_score == float("1" * 30) / 2


def test_status_is_stripped_of_all_white_space(spark):
    cells = ["R\t", "R\n", "R\u00a0", " r ", "G", "\u2003y"]
    r = K.kpi_status(tab(spark, "Project Inventory", [{"Status (R/Y/G)": c} for c in cells])).first()
    assert (r.red_projects_count, r.yellow_projects_count, r.green_projects_count) == (4, 1, 1)


def test_lists_agree_with_their_counts_when_a_column_is_absent(spark):
    import datetime as dt

    from pulseboard.operators import lists as L

    day = dt.date(2025, 6, 30)
    p = tab(spark, "Project Inventory", [{"Project Name": "p", "Project End Date": "2025-01-01"}, {"Project Name": "q"}])
    for missing in ("Next Opp First Discussion Date", "Project End Date", "Project Name"):
        d = p.drop(missing)
        assert L.overdue_next_deal(d, day).count() == K.next_deal_gap(d, day).first().overdue_next_deal_discussion_count == 0
    for missing in ("Last Sponsor Checkin Date", "Sponsor Checkin Notes", "Project End Date", "Project Name"):
        d = p.drop(missing)
        assert L.overdue_checkins(d, day).count() == K.kpi_checkins(d, day).first().overdue_sponsor_checkin_count == 0
    assert L.at_risk_projects(p.drop("Status (R/Y/G)")).count() == 0
    assert L.utilization_ranking(tab(spark, "Team Utilization", [{"Employee Name": "e"}]).drop("Role")).first().Role is None
    typed = p.withColumn("Revenue", F.lit(15_000_000.0))
    assert L.project_listing(typed).first().Revenue == "$15,000,000"


def test_values_of_a_median_are_counted_in_one_pass(spark):
    from pulseboard.functions.stats import medians

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    xs = [(float(i % 9),) for i in range(50)] + [(None,), (0.0,), (-4.5,), (float("nan"),)]
    df = spark.createDataFrame(xs, "x double").repartition(3)
    got = medians(df.mapInArrow(count, df.schema), {"m": F.col("x"), "n": F.when(F.col("x") < 0, F.col("x")), "none": F.lit(None).cast("double")}).first()
    assert (got.m, got.n, got.none) == (3.5, -4.5, None)  # ranks 26 and 27 of 52: 3 and 4
    assert seen.value == len(xs)
