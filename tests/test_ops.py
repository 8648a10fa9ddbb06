"""Staffing (C4), scorecard (C5), scenarios (C6), router (C7), updates (C10)."""

import datetime as dt

from conftest import tab
from pulseboard.operators import report as R
from pulseboard.operators import scenario as SC
from pulseboard.operators import scores as S
from pulseboard.operators import staffing as ST
from pulseboard.operators import updates as U
from pulseboard.sources.literal import literal_frame

D = dt.date(2025, 6, 30)


def test_staffing_c4(spark):
    staff = tab(spark, "Team Utilization", [
        {"Employee Name": "s1", "Project Assignments": "A, B ,A", "Utilization (%)": "80%", "Latest Pulse Score": "6"},
        {"Employee Name": "s2", "Project Assignments": "b", "Utilization (%)": "60%"},
        {"Employee Name": "s3", "Project Assignments": None},
    ])
    projects = tab(spark, "Project Inventory", [{"Project Name": n, "Client": "c"} for n in ("A", "B", "C")])
    got = {r["Project Name"]: (r["Assigned Team Size"], r["Assigned Team Members"], r["Avg. Team Utilization %"])
           for r in ST.staffing_health(projects, staff, D).collect()}
    assert got == {"A": (1, "s1", 80.0), "B": (1, "s1", 80.0), "C": (0, "N/A", 0.0)}


def test_scorecard_first_hit_c5(spark):
    mapping = tab(spark, "MappingTable", [
        {"Tab": "Project Inventory", "Question": "Q1", "Value": "Yes", "Score": "10"},
        {"Tab": "Project Inventory", "Question": "Q2", "Value": "Yes", "Score": "4"},
        {"Tab": "Pipeline", "Question": "Q1", "Value": "Yes", "Score": "7"},
    ])
    p = tab(spark, "Project Inventory", [{"Project Name": "p", "Timeline Health": "Yes", "Team Resourcing": "Yes",
                                          "Budget and Scope": "Other"}])
    r = S.project_health_lookup(p, mapping).first()
    assert r.project_health_score == 20.0
    t = S.weighted_totals(p, mapping).first()
    assert (t.project_health_score, t.delivery_efficiency_score, t.total_project_score) == (20.0, 0.0, 14.0)
    plan = S.project_health_lookup(p, mapping)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_total_deal_score(spark):
    mapping = tab(spark, "MappingTable", [
        {"Tab": "Pipeline", "Value": "Yes", "Score": "10"}, {"Key": "Sales|Low|High", "Score": "50"}])
    card = [c for c, _ in S.PIPELINE_SCORECARD][:2]
    p = tab(spark, "Pipeline", [{"Account": "a", card[0]: "Yes", card[1]: "Yes", "Pre-Sales Effort Level": "Low", "Revenue Potential Tier": "High"}])
    r = S.weighted_deal_totals(p, mapping).first()
    assert (r.pipeline_score, r.relational_efficiency_score) == (20.0, 50.0) and abs(r.total_deal_score - 29.0) < 1e-12


def scenario_rows(weeks="50"):
    vals = {"VP Hourly Selling Value": "$500", "VP Hours Weekly on Delivery": "10",
            "Head of Delivery Hourly Strategic Delivery Value": "$200",
            "Head of Delivery Weekly Tactical Delivery Hours": "20",
            "Avg. Cost of Turnover per Senior Employee": "$100,000", "% Projects at Risk": "30%",
            "Revenue at Risk due to troubled projects": "$1,000,000", "Work Weeks in a year": weeks}
    return [{"Assumption": k, "Value": v} for k, v in vals.items()]


def test_scenario_c6(spark):
    inputs = SC.scenario_inputs(tab(spark, "Scenario Model Inputs", scenario_rows()))
    r = SC.scenario_calc(inputs).first().asDict()
    expected = [-250000, -200000, -300000, -300000, 300000, 150000, 150000, 200000, -100000, -1050000, 700000]
    assert [r[c] for c in SC.CATEGORY_COLS] == [float(x) for x in expected]
    bad = SC.scenario_calc(SC.scenario_inputs(tab(spark, "Scenario Model Inputs", scenario_rows("1,000")))).first()
    assert bad.failed and all(bad[c] == 0.0 for c in SC.CATEGORY_COLS)


def test_scenario_last_label_wins_and_compare(spark):
    rows = scenario_rows() + [{"Assumption": "Work Weeks in a year", "Value": "40"}]
    base = SC.scenario_inputs(tab(spark, "Scenario Model Inputs", rows))
    assert base.where("Assumption = 'Work Weeks in a year'").first().value_num == 40.0
    over = literal_frame(spark, [("VP Hours Weekly on Delivery", "0")], [("Assumption", "string"), ("Value", "string")])
    prop = SC.override_inputs(base, over)
    cmp = {r.category: (r.do_nothing, r.proposed, r.difference, r.sort_order)
           for r in SC.scenario_compare(SC.scenario_calc(base), SC.scenario_calc(prop)).collect()}
    assert cmp["Lost Sales (VP involvement)"][1] in (0.0, -0.0)
    assert cmp["Total Positive Impact"][3] == 2 and cmp["Project Health Improvement"][3] == 0
    assert cmp["Regained VP Selling Time"][3] == 1


def test_sensitivity_has_both_ends(spark):
    base = SC.scenario_inputs(tab(spark, "Scenario Model Inputs", scenario_rows()))
    rows = {r.assumption: r for r in SC.sensitivity(base).collect()}
    r = rows["Work Weeks in a year"]
    assert r.low_value == 45.0 and abs(r.high_value - 55.0) < 1e-9 and r.impact_low < r.impact_high


def test_router_c7(spark):
    qs = literal_frame(spark, [(1, "What is TOTAL revenue?"), (2, "how many red projects"), (3, "red project list"),
                               (4, "total revenue and red project count")],
                       [("question_id", "bigint"), ("question", "string")])
    kpis = literal_frame(spark, [(1234567.0, 3)], [("total_revenue", "double"), ("red_projects_count", "bigint")])
    got = {r.question_id: (r.rule, r.answer) for r in R.route_questions(qs, kpis).collect()}
    assert got[1] == ("total_revenue", "Total revenue is $1,234,567.")
    assert got[2] == ("red_project_count", "There are 3 red projects.")
    assert got[3] == (None, None) and got[4][0] == "total_revenue"


def test_updates_c10(spark):
    df = tab(spark, "Project Inventory", [{"Project Name": "K", "Key Issues": "a"}, {"Project Name": "K", "Key Issues": "b"},
                                          {"Project Name": "L", "Key Issues": "c"}])
    upd = literal_frame(spark, [("K", "Key Issues", "new", 1), ("K", "Nope", "x", 2), ("Z", "Key Issues", "y", 3),
                                ("L", "Nope", "x", 4)],
                        [("key", "string"), ("column", "string"), ("value", "string"), ("seq", "bigint")])
    out = {r["_row"]: r["Key Issues"] for r in U.apply_updates(df, "Project Name", upd).collect()}
    assert out == {0: "new", 1: "b", 2: "c"}
    rep = {r.key: (r.status, r.n_fields) for r in U.update_report(df, "Project Name", upd).collect()}
    assert rep == {"K": ("applied", 1), "Z": ("key not found", 0), "L": ("no valid field", 0)}


def test_snapshot_caps_and_truncation(spark):
    big = tab(spark, "Talent Gaps", [{"Skill/Role Needed": f"s{i}"} for i in range(20)])
    snap = R.context_snapshot([("Talent Gaps", big), ("Operational Gaps", tab(spark, "Operational Gaps", []))])
    lines = [r.text for r in snap.orderBy("tab_order", "line_no").collect()]
    assert lines[0] == "Sheet: Talent Gaps" and len(lines) == 2 + 15 + 1
    assert lines[-1] == "... (showing top 15 of 20 rows)"
    t = R.context_text(snap, limit=50).first()
    assert t.truncated and t.context_text.endswith("\n... (data truncated)") and len(t.context_text) == 50 + 21


def test_sweep_overrides_only_present_labels(spark):
    base = SC.scenario_inputs(tab(spark, "Scenario Model Inputs", scenario_rows()))
    sweep = literal_frame(spark, [(1, 52.0, 0.5), (2, 50.0, 0.5)],
                          [("Scenario", "bigint"), ("weeks", "double"), ("chief", "double")])
    got = {r.Scenario: r for r in SC.scenario_sweep(
        base, sweep, ("Scenario",), {"Work Weeks in a year": "weeks", "Cost of Chief of Staff Salary": "chief"}).collect()}
    # weeks is present in the baseline (overridden); the salary label is absent, so its default stays
    assert got[2].net_vs_baseline == 0.0
    assert got[1].total_negative_impact < got[2].total_negative_impact
    assert got[2].total_positive_impact == 700000.0


def test_updates_need_the_key_column(spark):
    df = tab(spark, "Project Inventory", [{"Project Name": "K", "Key Issues": "a"}])
    upd = literal_frame(spark, [("K", "Key Issues", "new", 1)],
                        [("key", "string"), ("column", "string"), ("value", "string"), ("seq", "bigint")])
    assert U.apply_updates(df, "Missing Key", upd).first()["Key Issues"] == "a"
    assert U.update_report(df, "Missing Key", upd).first().status == "key column missing"


def test_kpi_all_on_empty_tabs(spark):
    from pulseboard.operators import kpis as K

    e = {t: tab(spark, t, []) for t in ("Project Inventory", "Pipeline", "Project Risks", "Team Utilization",
                                        "Executive Activity")}
    rows = K.kpi_all(e["Project Inventory"], e["Pipeline"], e["Project Risks"], e["Team Utilization"],
                     e["Executive Activity"], D).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert all(v == 0 or v == "N/A" for v in r.values()), {k: v for k, v in r.items() if v not in (0, "N/A")}


def test_sensitivity_ranges_per_assumption(spark):
    base = SC.scenario_inputs(tab(spark, "Scenario Model Inputs", scenario_rows()))
    ranges = tab(spark, "Sensitivity & Assumption Analysis", [
        {"Assumption/Scenario Input": "Work Weeks in a year", "Sensitivity Range": "±20%"},
        {"Assumption/Scenario Input": "Work Weeks in a year", "Sensitivity Range": "±30%"},
        {"Assumption/Scenario Input": "% Projects at Risk", "Sensitivity Range": "n/a"}])
    rows = {r.assumption: r for r in SC.sensitivity(base, ranges=ranges).collect()}
    assert rows["Work Weeks in a year"].low_value == 40.0  # first range row of the label wins
    assert rows["% Projects at Risk"].low_value == 27.0  # unparsable range -> default 10%
    assert rows["VP Hourly Selling Value"].high_value == 550.0


def test_rankings_break_ties_by_sheet_order(spark):
    from pulseboard.operators import lists as L

    staff = tab(spark, "Team Utilization", [{"Employee Name": n, "Role": "x", "Utilization (%)": u}
                                            for n, u in (("a", "50%"), ("b", "90%"), ("c", "90%"), ("d", "10%"))])
    assert [r["Employee Name"] for r in L.utilization_ranking(staff).collect()] == ["b", "c", "a", "d"]
    pipe = tab(spark, "Pipeline", [{"Account": n, "Pursuit Tier": t, "Percieved Annual AMO": a}
                                   for n, t, a in (("w", "Tier 1", "$5"), ("x", "TIER 1", "$9"), ("y", "tier 1", "$9"),
                                                   ("z", "Tier 2", "$99"), ("v", " Tier 1", "$50"))])
    got = [(r["rank"], r.account) for r in L.top_pursuits(pipe, n=5).orderBy("rank").collect()]
    assert got == [(1, "x"), (2, "y"), (3, "w")]  # upper-case match, no trim; ties in sheet order


def test_upcoming_text_and_its_fixed_sentence(spark):
    import datetime as dt

    from pulseboard.operators import lists as L

    p = tab(spark, "Project Inventory", [{"Project Name": f"p{i}", "Project End Date": f"2025-07-0{i + 1}"} for i in range(4)])
    lines = tab(spark, "Pipeline", [{"Account": "a", "Next Touchpoint Date": "2025-07-02"}, {"Account": "b", "Closed Won Date": "2025-07-02"}])
    got = L.upcoming_text(L.upcoming_dates(p, lines, dt.date(2025, 7, 1))).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(1, 7))
    assert got[0].line == "- Project 'p0' is scheduled to end on 2025-07-01."
    assert [r.line[:12] for r in got[4:]] == ["- Deal for '", "- Next touch"]
    none = L.upcoming_text(L.upcoming_dates(p, lines, dt.date(2020, 1, 1))).collect()
    assert [tuple(r) for r in none] == [(1, "No key dates identified in the next 7 days.")]
