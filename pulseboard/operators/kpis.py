"""The KPI bundle: global (or grouped) conditional aggregates, one scan per tab.

A *family* is a set of KPIs over one tab: ``aggs`` are measures (counts, exact sums, means, extremes),
``post`` are Columns over the aggregated row (ratios, percent of target).
``run`` evaluates any number of families of one tab in a single ``agg``, so
the whole project bundle is one scan of Project Inventory with partial
aggregation before the only exchange. ``by=()`` gives the one-row bundle;
``by=("Client",)`` gives the same KPIs for each client.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.exact import FAR, Mean, Sum, aggregate, far_mark
from ..functions.measures import Best, Const, Count, IntMean
from ..functions.stats import medians
from ..sources.tabs import ROW, q
from ..targets import DEFAULT_TARGETS, Targets

NA = "N/A"


@dataclass
class Family:
    aggs: list = field(default_factory=list)
    post: list = field(default_factory=list)
    medians: dict = field(default_factory=dict)


def run(df: DataFrame, families, by=()) -> DataFrame:
    """One aggregate over ``df`` for all ``families``; then the derived columns. Medians come from their own
    distributed job over the same rows and are joined by group (without groups: two single rows)."""
    aggs = [a for f in families for a in f.aggs]
    post = [p for f in families for p in f.post]
    found = {n: c for f in families for n, c in f.medians.items()}
    consts = [a for a in aggs if isinstance(a, Const)]
    g = aggregate(df, by, [a if isinstance(a, Sum) else a.column() for a in aggs if not isinstance(a, Const)])
    if consts:
        g = g.withColumns({a.name: a.value() for a in consts})
    if found:
        m = medians(df, found, by).select(*[q(b).alias(f"__by{i}") for i, b in enumerate(by)], *[F.col(n).alias(f"__{n}") for n in found])
        same = [q(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
        g = (g.join(m, same, "left") if by else g.crossJoin(m)).withColumns({n: F.coalesce(F.col(f"__{n}"), F.lit(0.0)) for n in found})
    return g.select(*[q(b) for b in by], *post)


def _has(df: DataFrame, *cols) -> bool:
    return all(c in df.columns for c in cols)


def _num(df: DataFrame, col: str) -> Column:
    return C.number_of(df, col)


# --------------------------------------------------------------------------
# Project Inventory
# --------------------------------------------------------------------------

def _with_far(df: DataFrame, *numbers: str) -> DataFrame:
    """``df`` with the mark of rows that hold a number the exact sums keep in parts."""
    return df.withColumn(FAR, far_mark(*numbers))


def _dated(df: DataFrame, columns: dict[str, str], dates: str) -> DataFrame:
    """``df`` with DATE columns of its text columns (null where one is absent). ``dates``: "iso" reads ISO dates
    only, "first" takes each column's format from its first value."""
    there = {n: c for n, c in columns.items() if c in df.columns}
    df = df.select("*", *[F.lit(None).cast("date").alias(n) for n in columns if n not in there])
    if not there:
        return df
    if dates == "first":
        return C.dates_by_first(df, there, ROW)
    if dates != "iso":
        raise ValueError(f"dates: {dates}")
    return df.withColumns({n: C.to_date(q(c)) for n, c in there.items()})


def project_frame(projects: DataFrame, dates: str = "iso") -> DataFrame:
    """Typed helper columns (prefixed ``__``) next to the raw text columns; as they are where stored already."""
    df = projects
    if "__end" in df.columns:
        return df
    cols = {
        "__revenue": _num(df, "Revenue"),
        "__status": C.status_kpi(q("Status (R/Y/G)")) if "Status (R/Y/G)" in df.columns else F.lit("UNKNOWN"),
        "__health": _num(df, "Project Health Score"),
        "__total": _num(df, "Total Project Score"),
        "__enps": _num(df, "eNPS"),
    }
    df = _dated(df, {"__end": "Project End Date", "__disc": "Next Opp First Discussion Date", "__checkin": "Last Sponsor Checkin Date"}, dates)
    return _with_far(df.withColumns(cols), "__revenue", "__health", "__total", "__enps")


def f_status(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    st, rev = F.col("__status"), F.col("__revenue")
    aggs = [
        Count("total_projects"),
        Count("red_projects_count", st == "R"),
        Sum("red_project_revenue", F.when(st == "R", rev)),
        Count("yellow_projects_count", st == "Y"),
        Count("green_projects_count", st == "G"),
    ]
    tot, green = F.col("total_projects"), F.col("green_projects_count")
    ratio = F.when(tot > 0, green / tot).otherwise(F.lit(0.0))
    post = [
        tot, F.col("red_projects_count"), F.col("red_project_revenue"),
        F.col("yellow_projects_count"), green,
        ratio.alias("green_project_ratio"),
        (ratio / F.lit(t.green_ratio) * 100.0).alias("green_project_ratio_vs_target_pct"),
    ]
    return Family(aggs, post)


def f_revenue(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    tot = F.col("total_revenue")
    return Family(
        [Sum("total_revenue", F.col("__revenue"))],
        [tot, (tot / F.lit(t.revenue) * 100.0).alias("revenue_vs_target_pct"),
         (tot / F.lit(t.revenue_stretch) * 100.0).alias("revenue_vs_stretch_pct")],
    )


def _score_stats(df: DataFrame, raw: str, typed: str, avg_name: str, med_name: str) -> Family:
    if raw not in df.columns:
        return Family([Const(avg_name, 0.0), Const(med_name, 0.0)], [F.col(avg_name), F.col(med_name)])
    return Family([Mean(avg_name, F.col(typed))], [F.col(avg_name), F.col(med_name)], {med_name: F.col(typed)})


def _extremes(df: DataFrame, raw: str, typed: str, name: str, top: str, bottom: str) -> Family:
    """Name at the highest / lowest score; ties go to the first row in sheet order."""
    if _has(df, raw, name):
        s, n = F.col(typed), q(name)
        aggs = [Best(top, n, F.struct((-s).alias("score"), F.col(ROW)), NA), Best(bottom, n, F.struct(s.alias("score"), F.col(ROW)), NA)]
    else:
        aggs = [Const(top, NA), Const(bottom, NA)]
    return Family(aggs, [F.col(top), F.col(bottom)])


def _both(a: Family, b: Family) -> Family:
    return Family(a.aggs + b.aggs, a.post + b.post, a.medians | b.medians)


def f_project_scores(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    """Mean and median of both project scores."""
    return _both(_score_stats(df, "Project Health Score", "__health", "avg_project_health_score", "median_project_health_score"),
                 _score_stats(df, "Total Project Score", "__total", "avg_total_project_score", "median_total_project_score"))


def f_project_extremes(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    a = _extremes(df, "Project Health Score", "__health", "Project Name",
                  "top_project_by_health_score", "bottom_project_by_health_score")
    b = _extremes(df, "Total Project Score", "__total", "Project Name",
                  "top_project_by_total_score", "bottom_project_by_total_score")
    return Family(a.aggs + b.aggs, a.post + b.post)


def f_nps(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    avg = F.col("avg_customer_nps")
    agg = Mean("avg_customer_nps", F.col("__enps")) if "eNPS" in df.columns else Const("avg_customer_nps", 0.0)
    return Family(
        [agg],
        [avg, F.when(avg != 0, avg / F.lit(t.nps) * 100.0).otherwise(F.lit(0.0)).alias("customer_nps_vs_target_pct")],
    )


def f_next_deal(df: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> Family:
    names = ("avg_next_deal_gap_days", "overdue_next_deal_discussion_count")
    if not _has(df, "Project Name", "Project End Date", "Next Opp First Discussion Date"):
        return Family([Const(names[0], 0.0), Const(names[1], 0)], [F.col(n) for n in names])
    end, disc, d = F.col("__end"), F.col("__disc"), F.lit(as_of)
    gap = C.day_diff(disc, end)
    return Family(
        [IntMean(names[0], F.when(gap >= 0, gap)), Count(names[1], overdue_next_deal_cond(as_of, t))],
        [F.col(n) for n in names],
    )


def overdue_next_deal_cond(as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> Column:
    end, disc, d = F.col("__end"), F.col("__disc"), F.lit(as_of)
    return end.isNotNull() & (C.day_diff(d, end) > t.next_deal_threshold_days) & disc.isNull() & (end < d)


def active_cond(as_of: dt.date) -> Column:
    end = F.col("__end")
    return end.isNull() | (end >= F.lit(as_of))


def notes_ok(notes: Column, strict: bool = False) -> Column:
    """Non-blank notes. By default a missing note passes, as the reference computes."""
    ok = C.strip(notes) != ""
    return F.coalesce(ok, F.lit(not strict))


def recent_checkin_cond(df: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS, strict_notes=False) -> Column:
    ck = F.col("__checkin")
    window_start = F.date_sub(F.lit(as_of), t.checkin_window_days)
    return active_cond(as_of) & ck.isNotNull() & (ck >= window_start) & notes_ok(q("Sponsor Checkin Notes"), strict_notes)


def overdue_checkin_cond(as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> Column:
    ck = F.col("__checkin")
    window_start = F.date_sub(F.lit(as_of), t.checkin_window_days)
    return active_cond(as_of) & (ck.isNull() | (ck < window_start))


def f_checkins(df: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS, strict_notes=False) -> Family:
    names = ("recent_meaningful_checkins_count", "recent_meaningful_checkins_pct", "overdue_sponsor_checkin_count")
    if not _has(df, "Project Name", "Last Sponsor Checkin Date", "Sponsor Checkin Notes", "Project End Date"):
        return Family([Const(names[0], 0), Const(names[1], 0.0), Const(names[2], 0)], [F.col(n) for n in names])
    active, recent = F.col("__active_projects"), F.col(names[0])
    return Family(
        [Count("__active_projects", active_cond(as_of)),
         Count(names[0], recent_checkin_cond(df, as_of, t, strict_notes)),
         Count(names[2], overdue_checkin_cond(as_of, t))],
        [recent,
         F.when(active > 0, recent / active * 100.0).otherwise(F.lit(0.0)).alias(names[1]),
         F.col(names[2])],
    )


# --------------------------------------------------------------------------
# Pipeline
# --------------------------------------------------------------------------

def pipeline_frame(pipeline: DataFrame, dates: str = "iso") -> DataFrame:
    df = pipeline
    if "__closed" in df.columns:
        return df
    df = _dated(df, {"__created": "Opportunity Created Date", "__closed": "Closed Won Date", "__touch": "Next Touchpoint Date"}, dates)
    return _with_far(df.withColumns({
        "__active": _num(df, "Open Pipeline_Active Work"),
        "__amo": _num(df, "Percieved Annual AMO"),
        "__pscore": _num(df, "Pipeline Score"),
        "__tscore": _num(df, "Total Deal Score"),
    }), "__active", "__amo", "__pscore", "__tscore")


def f_pipeline_values(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    act = F.col("active_pipeline_value")
    ratio = act / F.lit(t.revenue)
    return Family(
        [Sum("active_pipeline_value", F.col("__active")), Sum("total_potential_pipeline_value", F.col("__amo"))],
        [act, F.col("total_potential_pipeline_value"), ratio.alias("pipeline_coverage_ratio"),
         (ratio / F.lit(t.coverage) * 100.0).alias("pipeline_coverage_vs_target_pct")],
    )


def f_pipeline_scores(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    return _both(_score_stats(df, "Pipeline Score", "__pscore", "avg_pipeline_score", "median_pipeline_score"),
                 _score_stats(df, "Total Deal Score", "__tscore", "avg_total_deal_score", "median_total_deal_score"))


def f_pipeline_extremes(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    a = _extremes(df, "Pipeline Score", "__pscore", "Account", "top_pipeline_by_score", "bottom_pipeline_by_score")
    b = _extremes(df, "Total Deal Score", "__tscore", "Account", "top_pipeline_by_total_score", "bottom_pipeline_by_total_score")
    return Family(a.aggs + b.aggs, a.post + b.post)


def cycle_days() -> Column:
    return C.day_diff(F.col("__closed"), F.col("__created"))


def f_deal_cycle(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    names = ("avg_deal_cycle_time_days", "median_deal_cycle_time_days")
    if not _has(df, "Opportunity Created Date", "Closed Won Date"):
        return Family([Const(n, 0.0) for n in names], [F.col(n) for n in names])
    cyc = cycle_days()
    ok = F.when(cyc >= 0, cyc)
    return Family([IntMean(names[0], ok)], [F.col(n) for n in names], {names[1]: ok})


# --------------------------------------------------------------------------
# Risks, staff, executive activity
# --------------------------------------------------------------------------

def risk_frame(risks: DataFrame) -> DataFrame:
    df = risks
    if "__impact" in df.columns:
        return df
    sev = C.severity_kpi(q("Severity")) if "Severity" in df.columns else F.lit("unknown")
    return _with_far(df.withColumns({"__impact": _num(df, "Impact ($)"), "__sev": sev}), "__impact")


def f_risk(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    hi = F.col("__sev") == "high"
    imp = F.col("__impact")
    hi_imp, tot = F.col("high_severity_risk_impact"), F.col("total_risk_impact")
    return Family(
        [Count("high_severity_risk_count", hi), Sum("high_severity_risk_impact", F.when(hi, imp)),
         Sum("total_risk_impact", imp)],
        [F.col("high_severity_risk_count"), hi_imp, tot,
         F.when(tot != 0, hi_imp / tot * 100.0).otherwise(F.lit(0.0)).alias("high_risk_impact_as_pct_of_total")],
    )


def staff_frame(staff: DataFrame) -> DataFrame:
    df = staff
    if "__util" in df.columns:
        return df
    role = C.is_executive(q("Role")) if "Role" in df.columns else F.lit(False)
    return _with_far(df.withColumns({"__util": _num(df, "Utilization (%)"), "__pulse": _num(df, "Latest Pulse Score"),
                                     "__exec": role}), "__util", "__pulse")


def activity_frame(activity: DataFrame) -> DataFrame:
    if "__cost" in activity.columns:
        return activity
    return _with_far(activity.withColumn("__cost", _num(activity, "Strategic Cost ($)")), "__cost")


def impact_frame(impacts: DataFrame) -> DataFrame:
    """A scenario tab with its impact as a number."""
    if "__annual" in impacts.columns:
        return impacts
    return _with_far(impacts.withColumn("__annual", _num(impacts, "Annualized Impact ($)")), "__annual")


def f_pulse(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    avg = F.col("avg_employee_pulse_score")
    agg = Mean("avg_employee_pulse_score", F.col("__pulse")) if "Latest Pulse Score" in df.columns else Const("avg_employee_pulse_score", 0.0)
    return Family(
        [agg],
        [avg, F.when(avg != 0, avg / F.lit(t.pulse) * 100.0).otherwise(F.lit(0.0)).alias("employee_pulse_vs_target_pct")],
    )


def f_utilization(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    from ..targets import DELIVERY_OVER_UTILIZED, DELIVERY_UNDER_UTILIZED, EXEC_OVER_UTILIZED

    names = ("avg_exec_utilization_pct", "avg_delivery_utilization_pct", "over_utilized_execs_count",
             "under_utilized_delivery_count", "over_utilized_delivery_count")
    if not _has(df, "Role", "Utilization (%)"):
        return Family([Const(n, 0.0) for n in names[:2]] + [Const(n, 0) for n in names[2:]], [F.col(n) for n in names])
    ex, u = F.col("__exec"), F.col("__util")
    return Family(
        [Mean(names[0], F.when(ex, u)), Mean(names[1], F.when(~ex, u)),
         Count(names[2], ex & (u > EXEC_OVER_UTILIZED)),
         Count(names[3], ~ex & (u < DELIVERY_UNDER_UTILIZED)),
         Count(names[4], ~ex & (u > DELIVERY_OVER_UTILIZED))],
        [F.col(n) for n in names],
    )


def f_exec_cost(df: DataFrame, t: Targets = DEFAULT_TARGETS) -> Family:
    names = ("total_strategic_cost", "total_strategic_activities_count")
    if "Strategic Cost ($)" not in df.columns:
        return Family([Const(names[0], 0.0), Const(names[1], 0)], [F.col(n) for n in names])
    return Family([Sum(names[0], F.col("__cost")), Count(names[1])],
                  [F.col(n) for n in names])


# --------------------------------------------------------------------------
# Public jobs
# --------------------------------------------------------------------------

def kpi_status(projects: DataFrame, t: Targets = DEFAULT_TARGETS, by=()) -> DataFrame:
    pf = project_frame(projects)
    return run(pf, [f_status(pf, t)], by)


def kpi_revenue(projects: DataFrame, t: Targets = DEFAULT_TARGETS, by=()) -> DataFrame:
    pf = project_frame(projects)
    return run(pf, [f_revenue(pf, t)], by)


def project_scores(projects: DataFrame, by=()) -> DataFrame:
    pf = project_frame(projects)
    return run(pf, [f_project_scores(pf)], by)


def project_extremes(projects: DataFrame, by=()) -> DataFrame:
    pf = project_frame(projects)
    return run(pf, [f_project_extremes(pf)], by)


def kpi_pipeline(pipeline: DataFrame, t: Targets = DEFAULT_TARGETS, by=()) -> DataFrame:
    pf = pipeline_frame(pipeline)
    return run(pf, [f_pipeline_values(pf, t)], by)


def pipeline_scores(pipeline: DataFrame, by=()) -> DataFrame:
    pf = pipeline_frame(pipeline)
    return run(pf, [f_pipeline_scores(pf)], by)


def pipeline_extremes(pipeline: DataFrame, by=()) -> DataFrame:
    pf = pipeline_frame(pipeline)
    return run(pf, [f_pipeline_extremes(pf)], by)


def kpi_risk(risks: DataFrame, t: Targets = DEFAULT_TARGETS, by=()) -> DataFrame:
    rf = risk_frame(risks)
    return run(rf, [f_risk(rf, t)], by)


def kpi_satisfaction(projects: DataFrame, staff: DataFrame, t: Targets = DEFAULT_TARGETS) -> DataFrame:
    """NPS from projects and pulse from staff: two one-row aggregates side by side."""
    pf, sf = project_frame(projects), staff_frame(staff)
    a = run(pf, [f_nps(pf, t)])
    b = run(sf, [f_pulse(sf, t)])
    return a.crossJoin(b)  # both sides are global aggregates: exactly one row each


def deal_cycle(pipeline: DataFrame, by=()) -> DataFrame:
    pf = pipeline_frame(pipeline)
    return run(pf, [f_deal_cycle(pf)], by)


def deal_cycle_by_tier(pipeline: DataFrame) -> DataFrame:
    """Mean and median cycle per tier; negative cycles included, missing tier dropped."""
    pf = pipeline_frame(pipeline)
    if not _has(pf, "Opportunity Created Date", "Closed Won Date", "Pursuit Tier"):
        return pf.sparkSession.createDataFrame([], "`Pursuit Tier` string, mean_days double, median_days double")
    won = pf.where(F.col("__created").isNotNull() & F.col("__closed").isNotNull() & q("Pursuit Tier").isNotNull())
    cyc = cycle_days()
    tier = Family([IntMean("mean_days", cyc)], [F.col("mean_days"), F.col("median_days")], {"median_days": cyc})
    return run(won, [tier], ("Pursuit Tier",))


def next_deal_gap(projects: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS, by=()) -> DataFrame:
    pf = project_frame(projects)
    return run(pf, [f_next_deal(pf, as_of, t)], by)


def kpi_checkins(projects: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS, strict_notes=False, by=()) -> DataFrame:
    pf = project_frame(projects)
    return run(pf, [f_checkins(pf, as_of, t, strict_notes)], by)


def kpi_utilization(staff: DataFrame, by=()) -> DataFrame:
    sf = staff_frame(staff)
    return run(sf, [f_utilization(sf)], by)


def kpi_exec_cost(activity: DataFrame, by=()) -> DataFrame:
    af = activity_frame(activity)
    return run(af, [f_exec_cost(af)], by)


def kpi_all(projects: DataFrame, pipeline: DataFrame, risks: DataFrame, staff: DataFrame,
            activity: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> DataFrame:
    """Every scalar KPI in one row: one aggregate per tab, five scans in all.

    Each part is a global aggregate (exactly one row), so the cross joins
    below combine single rows and never multiply data.
    """
    out = None
    for tab, df in zip(BUNDLE, (projects, pipeline, risks, staff, activity), strict=True):
        frame, families = BUNDLE[tab]
        typed = frame(df)
        one = run(typed, families(typed, as_of, t))
        out = one if out is None else out.crossJoin(one)
    return out


#: Tabs of the bundle: the typed frame of each and its families.
BUNDLE = {
    "projects": (project_frame, lambda df, as_of, t: [f_status(df, t), f_revenue(df, t), f_project_scores(df, t), f_project_extremes(df),
                                                      f_nps(df, t), f_next_deal(df, as_of, t), f_checkins(df, as_of, t)]),
    "pipeline": (pipeline_frame, lambda df, as_of, t: [f_pipeline_values(df, t), f_pipeline_scores(df, t), f_pipeline_extremes(df), f_deal_cycle(df, t)]),
    "risks": (risk_frame, lambda df, as_of, t: [f_risk(df, t)]),
    "staff": (staff_frame, lambda df, as_of, t: [f_pulse(df, t), f_utilization(df)]),
    "exec_activity": (activity_frame, lambda df, as_of, t: [f_exec_cost(df)]),
}
