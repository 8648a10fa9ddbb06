"""Distribution, list, ranking and lookup queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as DI
from ..operators import lists as L
from ..sources.tabs import ROW, TAB_COLUMNS, q
from ..targets import PIPELINE_SCORE_BANDS, PROJECT_SCORE_BANDS, UPCOMING_EVENTS
from . import catalog as cat
from .catalog import AS_OF, query
from .driver_sql import D, lit
from .queries_core import ACTIVE, LF, OVERDUE_CK, OVERDUE_NEXT, PF, RF, SF, w
from .sqlfn import cnt, dsum, money0, num

HUNDRED = "CAST(100.0 AS DOUBLE)"
PIPE_ROW = "r1, r2, r3, r4, r5"


def s_band(x: str, bands) -> str:
    whens = " ".join(f"WHEN {x} BETWEEN CAST({float(lo)!r} AS DOUBLE) AND CAST({float(hi)!r} AS DOUBLE) THEN '{n}'"
                     for n, lo, hi in bands)
    return f"CASE {whens} ELSE 'N/A' END"


def s_band_distribution(frame: str, scores, bands) -> str:
    names = [n for n, _, _ in bands] + ["N/A"]
    aggs, sels = [], []
    for label, _raw, typed in scores:
        al = [f"{label}_{i}" for i in range(len(names))]
        aggs += [f"{cnt(s_band(typed, bands) + ' = ' + repr(n))} AS {a}" for n, a in zip(names, al)]
        valid = "(" + " + ".join(al[:-1]) + ")"
        for i, (n, a) in enumerate(zip(names, al)):
            pct = ("CAST(NULL AS DOUBLE)" if n == "N/A"
                   else f"CASE WHEN {valid} > 0 THEN {a} / {valid} * {HUNDRED} ELSE 0.0 END")
            sels.append(f"SELECT '{label}' AS score_name, '{n}' AS band, {i} AS band_order, {a} AS band_count, "
                        f"{pct} AS band_pct FROM agg")
    return f",\nagg AS (SELECT {', '.join(aggs)} FROM {frame})\n" + "\nUNION ALL ".join(sels)


@query("project_score_bands", w("projects", frames=[PF]) + s_band_distribution("pf", DI.PROJECT_SCORES, PROJECT_SCORE_BANDS))
def q_project_score_bands(spark, sf):
    return DI.project_score_bands(cat.typed_projects(spark, sf))


@query("pipeline_score_bands", w("pipeline", frames=[LF]) + s_band_distribution("lf", DI.PIPELINE_SCORES, PIPELINE_SCORE_BANDS))
def q_pipeline_score_bands(spark, sf):
    return DI.pipeline_score_bands(cat.typed_pipeline(spark, sf))


@query("score_bands_rows", w("projects", frames=[PF]) + f"""
SELECT _row, "Project Name", __health AS project_health_score, {s_band('__health', PROJECT_SCORE_BANDS)} AS health_band,
  __total AS total_project_score, {s_band('__total', PROJECT_SCORE_BANDS)} AS total_band
FROM pf""")
def q_score_bands_rows(spark, sf):
    return DI.score_bands_rows(cat.typed_projects(spark, sf))


def s_hist(frame: str, scores, bins: int = 10) -> str:
    long = "\n  UNION ALL ".join(
        f"SELECT '{label}' AS score_name, {typed} AS x, \"{raw}\" IS NOT NULL AS raw_present FROM {frame}"
        for label, raw, typed in scores)
    b = float(bins)
    return f"""SELECT score_name, bin, mn + (mx - mn) * bin / CAST({b!r} AS DOUBLE) AS bin_low,
  mn + (mx - mn) * (bin + 1) / CAST({b!r} AS DOUBLE) AS bin_high, COUNT(*) AS bin_count
FROM (
  SELECT l.score_name, mn, mx,
    CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((x - mn) / (mx - mn) * CAST({b!r} AS DOUBLE)), {bins - 1}) END AS INTEGER) AS bin
  FROM ({long}) l
  JOIN (SELECT score_name, min(x) AS mn, max(x) AS mx FROM ({long}) GROUP BY score_name
        HAVING {cnt('raw_present')} > 0) s ON l.score_name = s.score_name
) GROUP BY score_name, mn, mx, bin"""


@query("score_histogram", w("projects", "pipeline", frames=[PF, LF]) + "\n" + s_hist("pf", DI.PROJECT_SCORES)
       + "\nUNION ALL\n" + s_hist("lf", DI.PIPELINE_SCORES))
def q_score_histogram(spark, sf):
    return DI.score_histogram(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, sf))


def s_round_hist(frame: str, scores, bins: int = 10) -> str:
    """Every width of 1, 2, 5 times a power of ten as a row; per score the smallest whose bins suffice."""
    long = "\n  UNION ALL ".join(f"SELECT '{label}' AS score_name, {typed} AS x, \"{raw}\" IS NOT NULL AS raw_present FROM {frame}" for label, raw, typed in scores)
    edge = lambda i: f"(CASE WHEN d >= 0 THEN {i} * m * pow(10.0::DOUBLE, d) ELSE {i} * m / pow(10.0::DOUBLE, -d) END)"

    def place(x):
        i = f"floor(CASE WHEN d >= 0 THEN {x} / (m * pow(10.0::DOUBLE, d)) ELSE {x} * pow(10.0::DOUBLE, -d) / m END)"
        return f"({i} + CASE WHEN {edge(f'({i} + 1)')} <= {x} THEN 1 WHEN {edge(i)} > {x} THEN -1 ELSE 0 END)"
    return f"""SELECT score_name, CAST(i - low AS INTEGER) AS bin, {edge('i')} AS bin_low, {edge('(i + 1)')} AS bin_high, COUNT(*) AS bin_count FROM (
  SELECT l.score_name, m, d, low, {place('x')} AS i FROM ({long}) l JOIN (
    SELECT * FROM (SELECT score_name, m, d, {place('mn')} AS low, row_number() OVER (PARTITION BY score_name ORDER BY d, m) AS k
      FROM (SELECT score_name, min(x) AS mn, max(x) AS mx FROM ({long}) GROUP BY score_name HAVING {cnt('raw_present')} > 0)
      CROSS JOIN (SELECT CAST(a.range AS INTEGER) AS d, CAST(b.m AS DOUBLE) AS m FROM range(-15, 16) a, (VALUES (1), (2), (5)) b(m))
      WHERE (mx > mn OR (m = 1 AND d = 0)) AND {place('mx')} - {place('mn')} < {bins}) WHERE k = 1
  ) w ON l.score_name = w.score_name
) GROUP BY score_name, m, d, low, i"""


@query("score_round_histogram", w("projects", "pipeline", frames=[PF, LF]) + "\n" + s_round_hist("pf", DI.PROJECT_SCORES)
       + "\nUNION ALL\n" + s_round_hist("lf", DI.PIPELINE_SCORES))
def q_score_round_histogram(spark, sf):
    return DI.score_round_histogram(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, sf))


@query("risk_by_severity", w("risks", frames=[RF]) + f"""
SELECT COALESCE(upper(substr("Severity", 1, 1)) || lower(substr("Severity", 2)), 'Unknown') AS severity,
  {dsum('__impact')} AS total_impact, COUNT(*) AS risk_count
FROM rf GROUP BY 1""")
def q_risk_by_severity(spark, sf):
    return DI.risk_by_severity(cat.typed_risks(spark, sf))


# -- lists ------------------------------------------------------------------

@query("non_green_projects", w("projects") + """
SELECT _row, "Project Name", "Status (R/Y/G)", "Key Issues" FROM projects WHERE "Status (R/Y/G)" IN ('R', 'Y')""")
def q_non_green(spark, sf):
    return L.non_green_projects(cat.projects(spark, sf))


@query("at_risk_projects", w("projects") + f"""
SELECT _row, "Project Name", upper("Status (R/Y/G)") AS "Status (R/Y/G)", {money0(num('"Revenue"'))} AS "Revenue",
  "Key Issues", "Next Steps", "Executive Support Required"
FROM projects WHERE upper("Status (R/Y/G)") IN ('R', 'Y')""")
def q_at_risk(spark, sf):
    return L.at_risk_projects(cat.typed_projects(spark, sf))


@query("active_projects", w("projects", frames=[PF]) + f"""
SELECT _row, {', '.join(f'"{c}"' for c in TAB_COLUMNS["Project Inventory"])} FROM pf WHERE {ACTIVE}""")
def q_active_projects(spark, sf):
    return L.active_projects(cat.filed_projects(spark, sf), AS_OF)


@query("overdue_next_deal", w("projects", frames=[PF]) + f"""
SELECT _row, "Project Name", __end AS "Project End Date" FROM pf WHERE {OVERDUE_NEXT}""")
def q_overdue_next_deal(spark, sf):
    return L.overdue_next_deal(cat.filed_projects(spark, sf), AS_OF)


@query("overdue_checkins", w("projects", frames=[PF]) + f"""
SELECT _row, "Project Name", __checkin AS "Last Sponsor Checkin Date" FROM pf WHERE {OVERDUE_CK}""")
def q_overdue_checkins(spark, sf):
    return L.overdue_checkins(cat.filed_projects(spark, sf), AS_OF)


@query("project_listing", w("projects") + f"""
SELECT _row, "Project Name", "Client", "Status (R/Y/G)", {money0(num('"Revenue"'))} AS "Revenue",
  round_even({num('"Project Health Score"')}, 1) AS "Project Health Score", "Project End Date", "Key Issues"
FROM projects""")
def q_project_listing(spark, sf):
    return L.project_listing(cat.typed_projects(spark, sf))


@query("pipeline_listing", w("pipeline") + f"""
SELECT r1, r2, r3, r4, "Account", {money0(num('"Open Pipeline_Active Work"'))} AS "Open Pipeline_Active Work",
  {money0(num('"Percieved Annual AMO"'))} AS "Percieved Annual AMO",
  round_even({num('"Pipeline Score"')}, 1) AS "Pipeline Score", "Pursuit Tier", "Horizon",
  "Opportunity Created Date", "Closed Won Date"
FROM pipeline""")
def q_pipeline_listing(spark, sf):
    return _keys(L.pipeline_listing(cat.typed_pipeline(spark, sf)), ROW)


@query("utilization_ranking", w("staff", frames=[SF]) + """
SELECT "Employee Name", "Role", __util AS utilization_pct FROM sf ORDER BY __util DESC, _row""")
def q_utilization_ranking(spark, sf):
    return L.utilization_ranking(cat.typed_staff(spark, sf))


def _t(col, missing="N/A"):
    return f"COALESCE(\"{col}\", '{missing}')"


@query("top_pursuits", w("pipeline", frames=[LF]) + f"""
SELECT CAST(row_number() OVER (ORDER BY __amo DESC, {PIPE_ROW}) AS INTEGER) AS rank, "Account" AS account, __amo AS amo,
  {money0('__amo')} AS amo_text, {money0('__active')} AS opportunity_value_text,
  {_t('Pursuit Tier')} AS pursuit_tier, {_t('Horizon')} AS horizon,
  COALESCE(format('{{:,.1f}}', __pscore), 'N/A') AS pipeline_score_text, {_t('Deal Registered YN')} AS deal_registered,
  {_t('Opportunity Created Date')} AS opportunity_created, {_t('Last Touchpoint Date')} AS last_touchpoint,
  {_t('Key Client Contacts')} AS key_client_contacts, {_t('Internal Pursuit Team')} AS internal_pursuit_team,
  {_t('Win Themes')} AS win_themes, {_t('Known Competitors')} AS known_competitors,
  {_t('Notes', '')} AS notes, {_t('Actions', '')} AS actions, {_t('Help Needed', '')} AS help_needed
FROM lf WHERE upper("Pursuit Tier") = 'TIER 1'
ORDER BY __amo DESC, {PIPE_ROW} LIMIT 5""")
def q_top_pursuits(spark, sf):
    return L.top_pursuits(cat.typed_pipeline(spark, sf))


def _keys(df, row):
    """A pipeline row's order as plain columns r1 to r4."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return df.select(*[F.col(f"{row}.{k}").alias(f"r{i + 1}") for i, k in enumerate(keys)], *[q(c) for c in df.columns if c != row])


def _events(last: str = "") -> str:
    parts = []
    for rank, (kind, tab, name, date, pre, mid, post) in enumerate(UPCOMING_EVENTS):
        d = f'TRY_CAST("{date}" AS DATE)'
        frame, rows = ("projects", "_row AS project_row, NULL AS r1, NULL AS r2, NULL AS r3, NULL AS r4" + (", NULL AS r5" if last else "")) if tab == "Project Inventory" else \
            ("pipeline", "NULL AS project_row, r1, r2, r3, r4" + last)
        parts.append(f"SELECT {rank} AS kind_rank, '{kind}' AS event_kind, \"{name}\" AS name, {d} AS event_date, "
                     f"{lit(pre)} || COALESCE(\"{name}\", '') || {lit(mid)} || strftime({d}, '%Y-%m-%d') || {lit(post)} AS line, {rows} "
                     f"FROM {frame} WHERE {d} BETWEEN {D} AND {D} + 7")
    return "\nUNION ALL ".join(parts)


@query("upcoming_dates", w("projects", "pipeline") + "\n" + _events())
def q_upcoming_dates(spark, sf):
    return _keys(L.upcoming_dates(cat.filed_projects(spark, sf), cat.typed_pipeline(spark, sf), AS_OF), "pipeline_row")


@query("upcoming_text", w("projects", "pipeline") + f""",
ev AS ({_events(", r5")})
SELECT row_number() OVER (ORDER BY kind_rank, project_row, r1, r2, r3, r4, r5) AS line_no, line FROM ev""")
def q_upcoming_text(spark, sf):
    return L.upcoming_text(L.upcoming_dates(cat.filed_projects(spark, sf), cat.typed_pipeline(spark, sf), AS_OF))


@query("distinct_options", w("projects", "pipeline", frames=[PF]) + f"""
SELECT DISTINCT option_set, value FROM (
  SELECT 'project_name' AS option_set, COALESCE("Project Name", 'N/A') AS value FROM pf
  UNION ALL SELECT 'client', COALESCE("Client", 'N/A') FROM pf WHERE {ACTIVE}
  UNION ALL SELECT 'team_resourcing', COALESCE("Team Resourcing", 'N/A') FROM pf WHERE {ACTIVE}
  UNION ALL SELECT 'account', COALESCE("Account", 'N/A') FROM pipeline
  UNION ALL SELECT 'horizon', COALESCE("Horizon", 'N/A') FROM pipeline
  UNION ALL SELECT 'pursuit_tier', COALESCE("Pursuit Tier", 'N/A') FROM pipeline
) ORDER BY option_set, value""")
def q_distinct_options(spark, sf):
    return L.distinct_options(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, sf), AS_OF)


@query("entity_lookup", w("pipeline") + f"""
SELECT "Account" AS key, COALESCE("Horizon", '') AS horizon, COALESCE("Pursuit Tier", '') AS pursuit_tier,
  COALESCE("Notes", '') AS notes, COALESCE("Help Needed", '') AS help_needed, COALESCE("Actions", '') AS actions,
  CASE WHEN upper("Deal Registered YN") IN ('Y', 'N') THEN upper("Deal Registered YN") ELSE '' END AS deal_registered,
  COALESCE(TRY_CAST(replace(replace("Percieved Annual AMO", '$', ''), ',', '') AS DOUBLE), 0.0) AS amo
FROM (SELECT *, row_number() OVER (PARTITION BY "Account" ORDER BY {PIPE_ROW}) AS rn FROM pipeline
      WHERE "Account" IS NOT NULL)
WHERE rn = 1""")
def q_entity_lookup(spark, sf):
    return L.entity_lookup(cat.pipeline(spark, sf))


@query("project_form_lookup", w("projects") + """
SELECT "Project Name" AS key,
  CASE WHEN upper(COALESCE("Status (R/Y/G)", 'G')) IN ('R', 'Y', 'G') THEN upper(COALESCE("Status (R/Y/G)", 'G')) ELSE 'G' END AS status,
  COALESCE("Key Issues", '') AS key_issues, COALESCE("Next Steps", '') AS next_steps,
  TRY_CAST("Last Sponsor Checkin Date" AS DATE) AS checkin_date, COALESCE("Sponsor Checkin Notes", '') AS checkin_notes
FROM (SELECT *, row_number() OVER (PARTITION BY "Project Name" ORDER BY _row) AS rn FROM projects
      WHERE "Project Name" IS NOT NULL)
WHERE rn = 1""")
def q_project_form_lookup(spark, sf):
    return L.project_form_lookup(cat.projects(spark, sf))
