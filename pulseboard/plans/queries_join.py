"""Staffing join and scorecard queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scores as S
from ..operators import staffing as ST
from ..sources import driver
from ..sources.tabs import ROW
from ..targets import PIPELINE_SCORECARD, PROJECT_SCORECARD
from . import catalog as cat
from .catalog import AS_OF, query
from .driver_sql import qi
from .queries_core import ACTIVE, PF, w
from .queries_lists import s_band
from .sqlfn import dsum, num, xsum

STAFF_SQL = f""",
links AS (
  SELECT project, srow, name, util, pulse FROM (
    SELECT unnest(list_distinct(list_transform(string_split(COALESCE("Project Assignments", ''), ','), lambda e: trim(e)))) AS project,
      _row AS srow, "Employee Name" AS name, {num('"Utilization (%)"')} AS util, {num('"Latest Pulse Score"')} AS pulse
    FROM staff) WHERE project <> ''
),
team AS (
  SELECT project, COUNT(*) AS team_size, CAST(SUM(CAST(util AS DECIMAL(26,6))) AS DOUBLE) AS util_sum,
    CAST(SUM(CAST(pulse AS DECIMAL(26,6))) AS DOUBLE) AS pulse_sum, string_agg(name, ', ' ORDER BY srow) AS members
  FROM links GROUP BY project
)
SELECT pf."Project Name", "Client", "Status (R/Y/G)", "Team Resourcing",
  COALESCE(team_size, 0) AS "Assigned Team Size",
  CASE WHEN COALESCE(team_size, 0) > 0 THEN members ELSE 'N/A' END AS "Assigned Team Members",
  CASE WHEN COALESCE(team_size, 0) > 0 THEN util_sum / team_size ELSE 0.0 END AS "Avg. Team Utilization %",
  CASE WHEN COALESCE(team_size, 0) > 0 THEN pulse_sum / team_size ELSE 0.0 END AS "Avg. Team Pulse Score",
  COALESCE(CAST(__end AS VARCHAR), 'N/A') AS "Project End Date"
FROM pf LEFT JOIN team ON pf."Project Name" = team.project
WHERE {ACTIVE}"""


@query("staffing_health", w("projects", "staff", frames=[PF]) + STAFF_SQL)
def q_staffing_health(spark, sf):
    return ST.staffing_health(cat.typed_projects(spark, sf), cat.filed_staff(spark, sf), AS_OF)


@query("staffing_filtered", w("projects", "staff", frames=[PF]) + STAFF_SQL
       + " AND COALESCE(\"Team Resourcing\", 'N/A') = 'Understaffed'")
def q_staffing_filtered(spark, sf):
    return ST.staffing_health(cat.typed_projects(spark, sf), cat.filed_staff(spark, sf), AS_OF, resourcing="Understaffed")


def _first_value(tab):
    return (f"(SELECT \"Value\" AS lookup, arg_min({num(chr(34) + 'Score' + chr(34))}, _row) AS score FROM mapping "
            f"WHERE \"Tab\" = '{tab}' AND \"Value\" IS NOT NULL GROUP BY \"Value\")")


FIRST_KEY = (f"(SELECT \"Key\" AS lookup, arg_min({num(chr(34) + 'Score' + chr(34))}, _row) AS score FROM mapping "
             "WHERE \"Key\" IS NOT NULL GROUP BY \"Key\")")


def _unpivot(frame, cols, extra):
    return "\n  UNION ALL ".join(f"SELECT {extra}, {qi(c)} AS lookup FROM {frame}" for c in cols)


@query("health_score_lookup", w("projects", "mapping") + f"""
SELECT _row, "Project Name", {dsum('COALESCE(m.score, 0.0)', 6)} AS project_health_score
FROM ({_unpivot('projects', [c for c, _ in PROJECT_SCORECARD], '_row, "Project Name"')}) c
LEFT JOIN {_first_value('Project Inventory')} m ON c.lookup = m.lookup
GROUP BY _row, "Project Name\"""")
def q_health_score_lookup(spark, sf):
    return S.project_health_lookup(cat.projects(spark, sf), driver.mapping(spark))


@query("pipeline_score_lookup", w("pipeline", "mapping") + f"""
SELECT "Account", {dsum('COALESCE(m.score, 0.0)', 6)} AS pipeline_score
FROM ({_unpivot('pipeline', [c for c, _ in PIPELINE_SCORECARD], 'r1, r2, r3, r4, r5, "Account"')}) c
LEFT JOIN {_first_value('Pipeline')} m ON c.lookup = m.lookup
GROUP BY r1, r2, r3, r4, r5, "Account\"""")
def q_pipeline_score_lookup(spark, sf):
    return S.pipeline_score_lookup(cat.pipeline(spark, sf), driver.mapping(spark))


@query("efficiency_scores", w("projects", "pipeline", "mapping") + f"""
SELECT tab, name, pair_key, COALESCE(m.score, 0.0) AS efficiency_score FROM (
  SELECT 'Project Inventory' AS tab, "Project Name" AS name,
    concat_ws('|', 'Delivery', "Delivery Relational Effort", "Expansion Yield Tier") AS pair_key FROM projects
  UNION ALL
  SELECT 'Pipeline', "Account", concat_ws('|', 'Sales', "Pre-Sales Effort Level", "Revenue Potential Tier") FROM pipeline
) r LEFT JOIN {FIRST_KEY} m ON r.pair_key = m.lookup""")
def q_efficiency_scores(spark, sf):
    return S.efficiency_scores(cat.projects(spark, sf), cat.pipeline(spark, sf), driver.mapping(spark))


@query("weighted_totals", w("projects", "mapping") + f"""
SELECT _row, "Project Name", project_health_score, delivery_efficiency_score,
  project_health_score * CAST(0.7 AS DOUBLE) + delivery_efficiency_score * CAST(0.3 AS DOUBLE) AS total_project_score
FROM (
  SELECT _row, "Project Name",
    {dsum("CASE WHEN kind = 'value' THEN COALESCE(score, 0.0) END", 6)} AS project_health_score,
    {dsum("CASE WHEN kind = 'pair' THEN COALESCE(score, 0.0) END", 6)} AS delivery_efficiency_score
  FROM (
    SELECT c._row, c."Project Name", c.kind, m.score FROM (
      {_unpivot('projects', [c for c, _ in PROJECT_SCORECARD], "_row, \"Project Name\", 'value' AS kind")}
      UNION ALL SELECT _row, "Project Name", 'pair', concat_ws('|', 'Delivery', "Delivery Relational Effort",
        "Expansion Yield Tier") FROM projects
    ) c LEFT JOIN (SELECT 'value' AS kind, * FROM {_first_value('Project Inventory')}
                   UNION ALL SELECT 'pair', * FROM {FIRST_KEY}) m
      ON c.kind = m.kind AND c.lookup = m.lookup
  ) GROUP BY _row, "Project Name"
)""")
def q_weighted_totals(spark, sf):
    return S.weighted_totals(cat.projects(spark, sf), driver.mapping(spark))


@query("weighted_deal_totals", w("pipeline", "mapping") + f"""
SELECT r1, r2, r3, r4, "Account", pipeline_score, relational_efficiency_score,
  pipeline_score * CAST(0.7 AS DOUBLE) + relational_efficiency_score * CAST(0.3 AS DOUBLE) AS total_deal_score
FROM (
  SELECT p.r1, p.r2, p.r3, p.r4, p."Account", {' + '.join(f'COALESCE(m{i}.score, 0.0)' for i in range(len(PIPELINE_SCORECARD)))} AS pipeline_score,
    COALESCE(k.score, 0.0) AS relational_efficiency_score
  FROM pipeline p
  {' '.join(f"LEFT JOIN {_first_value('Pipeline')} m{i} ON p.{qi(c)} = m{i}.lookup" for i, (c, _) in enumerate(PIPELINE_SCORECARD))}
  LEFT JOIN {FIRST_KEY} k ON concat_ws('|', 'Sales', p."Pre-Sales Effort Level", p."Revenue Potential Tier") = k.lookup
)""")
def q_weighted_deal_totals(spark, sf):
    t = S.weighted_deal_totals(cat.pipeline(spark, sf), driver.mapping(spark))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.select(*[F.col(f"{ROW}.{k}").alias(f"r{i + 1}") for i, k in enumerate(keys)], *[c for c in t.columns if c != ROW])


@query("letter_bands", w("projects", "pipeline") + f"""
SELECT 'Project Inventory' AS tab, "Project Name" AS name, {num('"Project Health Score"')} AS score,
  {s_band(num('"Project Health Score"'), S.PROJECT_LETTERS)} AS letter_band FROM projects
UNION ALL
SELECT 'Pipeline', "Account", {num('"Pipeline Score"')}, {s_band(num('"Pipeline Score"'), S.PIPELINE_LETTERS)} FROM pipeline""")
def q_letter_bands(spark, sf):
    return S.letter_bands(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, sf))


@query("margin", f"""
SELECT 'Project ' || CAST(l_orderkey AS VARCHAR) AS project, revenue, cost,
  CASE WHEN revenue <> 0 THEN (revenue - cost) / revenue END AS margin
FROM (SELECT l_orderkey, {xsum('l_extendedprice')} AS revenue, {xsum('round(p_retailprice * l_quantity, 4)')} AS cost
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)""")
def q_margin(spark, sf):
    li = driver.read(spark, sf, "lineitem")
    p = driver.read(spark, sf, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    m = S.margin(j, F.col("l_extendedprice"), F.round(F.col("p_retailprice") * F.col("l_quantity"), 4), ["l_orderkey"])
    return m.select(F.concat(F.lit("Project "), F.col("l_orderkey").cast("string")).alias("project"),
                    "revenue", "cost", "margin")
