"""Cleaning and KPI-bundle queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import kpis as K
from ..sources.tabs import ROW, q
from . import catalog as cat
from .catalog import AS_OF, query
from .driver_sql import D, with_tabs
from .sqlfn import cnt, days, dmean, dsum, dte, imean, med, num

F9 = "CAST(0.9 AS DOUBLE)"
HUNDRED = "CAST(100.0 AS DOUBLE)"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# -- typed frames in SQL (mirror of operators/kpis.*_frame) -----------------

PF = f"""pf AS (
  SELECT *, {num('"Revenue"')} AS __revenue, upper(regexp_replace("Status (R/Y/G)", '[^A-Za-z]', '', 'g')) AS __status,
    {num('"Project Health Score"')} AS __health, {num('"Total Project Score"')} AS __total,
    {num('"eNPS"')} AS __enps, {dte('"Project End Date"')} AS __end,
    {dte('"Next Opp First Discussion Date"')} AS __disc, {dte('"Last Sponsor Checkin Date"')} AS __checkin
  FROM projects
)"""

LF = f"""lf AS (
  SELECT *, {num('"Open Pipeline_Active Work"')} AS __active, {num('"Percieved Annual AMO"')} AS __amo,
    {num('"Pipeline Score"')} AS __pscore, {num('"Total Deal Score"')} AS __tscore,
    {dte('"Opportunity Created Date"')} AS __created, {dte('"Closed Won Date"')} AS __closed
  FROM pipeline
)"""

RF = f"""rf AS (
  SELECT *, {num('"Impact ($)"')} AS __impact, lower("Severity") AS __sev FROM risks
)"""

SF = f"""sf AS (
  SELECT *, {num('"Utilization (%)"')} AS __util, {num('"Latest Pulse Score"')} AS __pulse,
    COALESCE(contains(lower("Role"), 'executive'), false) AS __exec
  FROM staff
)"""


def w(*tabs: str, frames=()) -> str:
    return with_tabs(*tabs) + "".join(",\n" + f for f in frames)


# -- KPI families in SQL: (aggregates, derived) -----------------------------

def s_status():
    red, yel, grn = "__status = 'R'", "__status = 'Y'", "__status = 'G'"
    red_rev = "CASE WHEN __status = 'R' THEN __revenue END"
    aggs = ["COUNT(*) AS total_projects", f"{cnt(red)} AS red_projects_count",
            f"{dsum(red_rev)} AS red_project_revenue",
            f"{cnt(yel)} AS yellow_projects_count", f"{cnt(grn)} AS green_projects_count"]
    ratio = "(CASE WHEN total_projects > 0 THEN green_projects_count / total_projects ELSE 0.0 END)"
    post = ["total_projects", "red_projects_count", "red_project_revenue", "yellow_projects_count",
            "green_projects_count", f"{ratio} AS green_project_ratio",
            f"{ratio} / {F9} * {HUNDRED} AS green_project_ratio_vs_target_pct"]
    return aggs, post


def s_revenue():
    return ([f"{dsum('__revenue')} AS total_revenue"],
            ["total_revenue", f"total_revenue / {dbl(15e6)} * {HUNDRED} AS revenue_vs_target_pct",
             f"total_revenue / {dbl(20e6)} * {HUNDRED} AS revenue_vs_stretch_pct"])


def s_scores(typed_a, avg_a, med_a, typed_b, avg_b, med_b):
    aggs = [f"{dmean(typed_a)} AS {avg_a}", f"{med(typed_a)} AS {med_a}",
            f"{dmean(typed_b)} AS {avg_b}", f"{med(typed_b)} AS {med_b}"]
    return aggs, [avg_a, med_a, avg_b, med_b]


def s_extremes(name, typed_a, top_a, bot_a, typed_b, top_b, bot_b, row="_row"):
    aggs = [f"COALESCE(arg_min({name}, (-({typed_a}), {row})), 'N/A') AS {top_a}",
            f"COALESCE(arg_min({name}, ({typed_a}, {row})), 'N/A') AS {bot_a}",
            f"COALESCE(arg_min({name}, (-({typed_b}), {row})), 'N/A') AS {top_b}",
            f"COALESCE(arg_min({name}, ({typed_b}, {row})), 'N/A') AS {bot_b}"]
    return aggs, [top_a, bot_a, top_b, bot_b]


def s_nps():
    return ([f"{dmean('__enps')} AS avg_customer_nps"],
            ["avg_customer_nps", f"CASE WHEN avg_customer_nps <> 0 THEN avg_customer_nps / {dbl(50)} * {HUNDRED} "
                                 "ELSE 0.0 END AS customer_nps_vs_target_pct"])


OVERDUE_NEXT = f"(__end IS NOT NULL AND {days(D, '__end')} > 30 AND __disc IS NULL AND __end < {D})"
ACTIVE = f"(__end IS NULL OR __end >= {D})"
RECENT = (f"({ACTIVE} AND __checkin IS NOT NULL AND __checkin >= {D} - 30 "
          "AND COALESCE(regexp_replace(\"Sponsor Checkin Notes\", '^\\s+|\\s+$', '', 'g') <> '', true))")
OVERDUE_CK = f"({ACTIVE} AND (__checkin IS NULL OR __checkin < {D} - 30))"


def s_next_deal():
    gap = days("__disc", "__end")
    return ([f"{imean(f'CASE WHEN {gap} >= 0 THEN {gap} END')} AS avg_next_deal_gap_days",
             f"{cnt(OVERDUE_NEXT)} AS overdue_next_deal_discussion_count"],
            ["avg_next_deal_gap_days", "overdue_next_deal_discussion_count"])


def s_checkins():
    return ([f"{cnt(ACTIVE)} AS __active_projects", f"{cnt(RECENT)} AS recent_meaningful_checkins_count",
             f"{cnt(OVERDUE_CK)} AS overdue_sponsor_checkin_count"],
            ["recent_meaningful_checkins_count",
             f"CASE WHEN __active_projects > 0 THEN recent_meaningful_checkins_count / __active_projects * {HUNDRED} "
             "ELSE 0.0 END AS recent_meaningful_checkins_pct", "overdue_sponsor_checkin_count"])


def s_pipeline_values():
    ratio = f"(active_pipeline_value / {dbl(15e6)})"
    return ([f"{dsum('__active')} AS active_pipeline_value", f"{dsum('__amo')} AS total_potential_pipeline_value"],
            ["active_pipeline_value", "total_potential_pipeline_value", f"{ratio} AS pipeline_coverage_ratio",
             f"{ratio} / {dbl(3.0)} * {HUNDRED} AS pipeline_coverage_vs_target_pct"])


CYCLE = days("__closed", "__created")


def s_deal_cycle():
    ok = f"CASE WHEN {CYCLE} >= 0 THEN {CYCLE} END"
    return ([f"{imean(ok)} AS avg_deal_cycle_time_days", f"{med(ok)} AS median_deal_cycle_time_days"],
            ["avg_deal_cycle_time_days", "median_deal_cycle_time_days"])


def s_risk():
    hi = "__sev = 'high'"
    return ([f"{cnt(hi)} AS high_severity_risk_count", f"{dsum(f'CASE WHEN {hi} THEN __impact END')} AS high_severity_risk_impact",
             f"{dsum('__impact')} AS total_risk_impact"],
            ["high_severity_risk_count", "high_severity_risk_impact", "total_risk_impact",
             f"CASE WHEN total_risk_impact <> 0 THEN high_severity_risk_impact / total_risk_impact * {HUNDRED} "
             "ELSE 0.0 END AS high_risk_impact_as_pct_of_total"])


def s_pulse():
    return ([f"{dmean('__pulse')} AS avg_employee_pulse_score"],
            ["avg_employee_pulse_score", f"CASE WHEN avg_employee_pulse_score <> 0 THEN avg_employee_pulse_score / "
                                         f"{dbl(8.0)} * {HUNDRED} ELSE 0.0 END AS employee_pulse_vs_target_pct"])


def s_utilization():
    return ([f"{dmean('CASE WHEN __exec THEN __util END')} AS avg_exec_utilization_pct",
             f"{dmean('CASE WHEN NOT __exec THEN __util END')} AS avg_delivery_utilization_pct",
             f"{cnt('__exec AND __util > 70')} AS over_utilized_execs_count",
             f"{cnt('NOT __exec AND __util < 70')} AS under_utilized_delivery_count",
             f"{cnt('NOT __exec AND __util > 100')} AS over_utilized_delivery_count"],
            ["avg_exec_utilization_pct", "avg_delivery_utilization_pct", "over_utilized_execs_count",
             "under_utilized_delivery_count", "over_utilized_delivery_count"])


def s_exec_cost():
    return ([f"{dsum(num(chr(34) + 'Strategic Cost ($)' + chr(34)))} AS total_strategic_cost",
             "COUNT(*) AS total_strategic_activities_count"],
            ["total_strategic_cost", "total_strategic_activities_count"])


def s_run(frame: str, *families) -> str:
    aggs = [a for f in families for a in f[0]]
    post = [p for f in families for p in f[1]]
    return f"SELECT {', '.join(post)} FROM (SELECT {', '.join(aggs)} FROM {frame})"


S_PROJ_EXT = ('"Project Name"', "__health", "top_project_by_health_score", "bottom_project_by_health_score",
              "__total", "top_project_by_total_score", "bottom_project_by_total_score")
S_PIPE_EXT = ('"Account"', "__pscore", "top_pipeline_by_score", "bottom_pipeline_by_score",
              "__tscore", "top_pipeline_by_total_score", "bottom_pipeline_by_total_score")
S_PROJ_SC = ("__health", "avg_project_health_score", "median_project_health_score",
             "__total", "avg_total_project_score", "median_total_project_score")
S_PIPE_SC = ("__pscore", "avg_pipeline_score", "median_pipeline_score",
             "__tscore", "avg_total_deal_score", "median_total_deal_score")
PIPE_ROW = "(r1, r2, r3, r4, r5)"


# -- cleaning ---------------------------------------------------------------

@query("clean_tab", w("projects") + "\nSELECT * FROM projects")
def q_clean_tab(spark, sf):
    """Header trim, accepted spellings, '' -> null, blank rows dropped (the ingest step itself)."""
    from ..sources import driver
    from ..sources.tabs import clean_tab

    return clean_tab(driver.projects(spark, sf, AS_OF), "Project Inventory")


@query("clean_numeric", w("projects") + f"""
SELECT _row, "Revenue" AS revenue_text, {num('"Revenue"')} AS revenue,
  COALESCE(TRY_CAST(replace(replace("Revenue", '$', ''), ',', '') AS DOUBLE), 0.0) AS revenue_form,
  {num('"Project Health Score"')} AS project_health_score, {num('"eNPS"')} AS enps
FROM projects""")
def q_clean_numeric(spark, sf):
    p = cat.projects(spark, sf)
    return p.select(F.col(ROW), q("Revenue").alias("revenue_text"), C.to_number(q("Revenue")).alias("revenue"),
                    C.amo_form_number(q("Revenue")).alias("revenue_form"),
                    C.to_number(q("Project Health Score")).alias("project_health_score"),
                    C.to_number(q("eNPS")).alias("enps"))


@query("clean_dates", w("projects") + f"""
SELECT _row, {dte('"Project Start Date"')} AS start_date, {dte('"Project End Date"')} AS end_date,
  {dte('"Next Opp First Discussion Date"')} AS discussion_date, {dte('"Last Sponsor Checkin Date"')} AS checkin_date
FROM projects""")
def q_clean_dates(spark, sf):
    p = cat.projects(spark, sf)
    return p.select(F.col(ROW), C.to_date(q("Project Start Date")).alias("start_date"),
                    C.to_date(q("Project End Date")).alias("end_date"),
                    C.to_date(q("Next Opp First Discussion Date")).alias("discussion_date"),
                    C.to_date(q("Last Sponsor Checkin Date")).alias("checkin_date"))


def _format_sql(c: str, first: str) -> str:
    """Format of a column by its first value, and its cells read by it."""
    first_number = f"TRY_CAST(regexp_extract({first}, '^([0-9]+)', 1) AS INTEGER)"
    sep = f"regexp_extract({first}, '^[0-9]+([./-])', 1)"
    return (f"CAST(CASE WHEN regexp_matches({first}, '^[0-9]{{4}}-[0-9]+-[0-9]+$') THEN try_strptime({c}, '%Y-%m-%d') "
            f"WHEN {first_number} > 12 AND {sep} = '.' THEN try_strptime({c}, '%d.%m.%Y') WHEN {first_number} > 12 AND {sep} = '/' THEN try_strptime({c}, '%d/%m/%Y') "
            f"WHEN {sep} = '/' THEN try_strptime({c}, '%m/%d/%Y') END AS DATE)")


SHEET_DATES = ("iso_text", "day_first_text", "month_first_text")


@query("dates_by_first", f"""
WITH sheet AS (
  SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_text,
    CASE WHEN o_orderkey % 17 = 0 THEN 'tbd' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day_first_text,
    CASE WHEN o_orderkey % 19 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS month_first_text
  FROM orders WHERE day(o_orderdate) > 12 OR o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE day(o_orderdate) > 12)),
f AS (SELECT {', '.join(f"arg_min({c}, _row) FILTER ({c} IS NOT NULL) AS f_{c}" for c in SHEET_DATES)} FROM sheet)
SELECT _row, {', '.join(f"{c}, {_format_sql(c, 'f_' + c)} AS {c[:-5]}" for c in SHEET_DATES)} FROM sheet CROSS JOIN f""")
def q_dates_by_first(spark, sf):
    """Date columns in three spellings, each read by the format of its first cell. The sheet begins with a day
    that can't be a month."""
    from ..sources import driver

    o = driver.read(spark, sf, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    start = o.where(F.dayofmonth(day) > 12).agg(F.min("o_orderkey").alias("__start"))
    text = lambda f: F.date_format(day, f)
    sheet = o.crossJoin(start).where((F.dayofmonth(day) > 12) | (k > F.col("__start"))).select(  # one row
        k.alias(ROW), F.when(k % 11 == 0, text("dd.MM.yyyy")).when(k % 13 != 0, text("yyyy-MM-dd")).alias("iso_text"),
        F.when(k % 17 == 0, F.lit("tbd")).otherwise(text("dd.MM.yyyy")).alias("day_first_text"),
        F.when(k % 19 == 0, text("yyyy-MM-dd")).otherwise(text("MM/dd/yyyy")).alias("month_first_text"))
    return C.dates_by_first(sheet, {c[:-5]: c for c in SHEET_DATES})


# -- KPI bundle -------------------------------------------------------------

@query("kpi_status", w("projects", frames=[PF]) + "\n" + s_run("pf", s_status()))
def q_kpi_status(spark, sf):
    return K.kpi_status(cat.typed_projects(spark, sf))


@query("kpi_status_by_client", w("projects", frames=[PF]) + "\n" + s_run("pf", s_status()).replace(
    "SELECT total_projects", 'SELECT "Client", total_projects', 1).replace(
    "(SELECT COUNT(*)", '(SELECT "Client", COUNT(*)', 1).replace("FROM pf)", 'FROM pf GROUP BY "Client")'))
def q_kpi_status_by_client(spark, sf):
    return K.kpi_status(cat.typed_projects(spark, sf), by=("Client",))


@query("kpi_revenue", w("projects", frames=[PF]) + "\n" + s_run("pf", s_revenue()))
def q_kpi_revenue(spark, sf):
    return K.kpi_revenue(cat.filed_projects(spark, sf))


@query("project_scores", w("projects", frames=[PF]) + "\n" + s_run("pf", s_scores(*S_PROJ_SC)))
def q_project_scores(spark, sf):
    return K.project_scores(cat.typed_projects(spark, sf))


@query("project_extremes", w("projects", frames=[PF]) + "\n" + s_run("pf", s_extremes(*S_PROJ_EXT)))
def q_project_extremes(spark, sf):
    return K.project_extremes(cat.typed_projects(spark, sf))


@query("kpi_pipeline", w("pipeline", frames=[LF]) + "\n" + s_run("lf", s_pipeline_values()))
def q_kpi_pipeline(spark, sf):
    return K.kpi_pipeline(cat.typed_pipeline(spark, sf))


@query("pipeline_scores", w("pipeline", frames=[LF]) + "\n" + s_run("lf", s_scores(*S_PIPE_SC)))
def q_pipeline_scores(spark, sf):
    return K.pipeline_scores(cat.typed_pipeline(spark, sf))


@query("pipeline_extremes", w("pipeline", frames=[LF]) + "\n" + s_run("lf", s_extremes(*S_PIPE_EXT, row=PIPE_ROW)))
def q_pipeline_extremes(spark, sf):
    return K.pipeline_extremes(cat.typed_pipeline(spark, sf))


@query("kpi_risk", w("risks", frames=[RF]) + "\n" + s_run("rf", s_risk()))
def q_kpi_risk(spark, sf):
    return K.kpi_risk(cat.risk_numbers(spark, sf))


@query("kpi_satisfaction", w("projects", "staff", frames=[PF, SF]) + "\nSELECT * FROM ("
       + s_run("pf", s_nps()) + ") a CROSS JOIN (" + s_run("sf", s_pulse()) + ") b")
def q_kpi_satisfaction(spark, sf):
    return K.kpi_satisfaction(cat.typed_projects(spark, sf), cat.typed_staff(spark, sf))


@query("deal_cycle", w("pipeline", frames=[LF]) + "\n" + s_run("lf", s_deal_cycle()))
def q_deal_cycle(spark, sf):
    return K.deal_cycle(cat.typed_pipeline(spark, sf))


@query("deal_cycle_by_tier", w("pipeline", frames=[LF]) + f"""
SELECT "Pursuit Tier", {imean(CYCLE)} AS mean_days, {med(CYCLE)} AS median_days
FROM lf WHERE __created IS NOT NULL AND __closed IS NOT NULL AND "Pursuit Tier" IS NOT NULL
GROUP BY "Pursuit Tier\"""")
def q_deal_cycle_by_tier(spark, sf):
    return K.deal_cycle_by_tier(cat.typed_pipeline(spark, sf))


@query("next_deal_gap", w("projects", frames=[PF]) + "\n" + s_run("pf", s_next_deal()))
def q_next_deal_gap(spark, sf):
    return K.next_deal_gap(cat.typed_projects(spark, sf), AS_OF)


@query("kpi_checkins", w("projects", frames=[PF]) + "\n" + s_run("pf", s_checkins()))
def q_kpi_checkins(spark, sf):
    return K.kpi_checkins(cat.typed_projects(spark, sf), AS_OF)


@query("kpi_utilization", w("staff", frames=[SF]) + "\n" + s_run("sf", s_utilization()))
def q_kpi_utilization(spark, sf):
    return K.kpi_utilization(cat.typed_staff(spark, sf))


@query("kpi_exec_cost", w("exec_activity") + "\n" + s_run("exec_activity", s_exec_cost()))
def q_kpi_exec_cost(spark, sf):
    return K.kpi_exec_cost(cat.typed_activity(spark, sf))


KPI_TABS = ("projects", "pipeline", "risks", "staff", "exec_activity")
KPI_FRAMES = [PF, LF, RF, SF]
KPI_ALL_SELECT = (
    "SELECT * FROM ("
    + s_run("pf", s_status(), s_revenue(), s_scores(*S_PROJ_SC), s_extremes(*S_PROJ_EXT), s_nps(), s_next_deal(),
            s_checkins())
    + ") p CROSS JOIN ("
    + s_run("lf", s_pipeline_values(), s_scores(*S_PIPE_SC), s_extremes(*S_PIPE_EXT, row=PIPE_ROW), s_deal_cycle())
    + ") l CROSS JOIN (" + s_run("rf", s_risk()) + ") r CROSS JOIN ("
    + s_run("sf", s_pulse(), s_utilization()) + ") s CROSS JOIN ("
    + s_run("exec_activity", s_exec_cost()) + ") e"
)
KPI_ALL_SQL = w(*KPI_TABS, frames=KPI_FRAMES) + "\n" + KPI_ALL_SELECT


@query("kpi_all", KPI_ALL_SQL)
def q_kpi_all(spark, sf):
    return K.kpi_all(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, sf), cat.typed_risks(spark, sf),
                     cat.typed_staff(spark, sf), cat.typed_activity(spark, sf), AS_OF)
