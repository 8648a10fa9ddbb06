"""Write-back, snapshot, export and KPI presentation queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpis as K
from ..operators import report as R
from ..operators import updates as U
from ..sources import driver
from ..sources.store import FirstRows
from ..sources.tabs import ROW, TAB_COLUMNS, q
from ..targets import DEFAULT_TARGETS, METRIC_CARDS, SNAPSHOT_DIGEST_MARK, SNAPSHOT_TRUNCATION_MARK
from . import catalog as cat
from .catalog import AS_OF, query
from .driver_sql import lit, qi, with_tabs
from .queries_core import KPI_ALL_SELECT, KPI_FRAMES, KPI_TABS, PF, s_revenue, s_run, s_status, w

PROJECT_OUT = list(TAB_COLUMNS["Project Inventory"])
PIPELINE_OUT = list(TAB_COLUMNS["Pipeline"])


def s_apply(tab: str, key: str, updates: str, known, out_cols, order: str, drop_blank: bool, row_out: str) -> str:
    known_sql = ", ".join(lit(c) for c in known)
    blank = " AND value <> ''" if drop_blank else ""
    touched = [c for c in out_cols if c in known]
    wide_cols = ", ".join(
        f"max(CASE WHEN \"column\" = {lit(c)} THEN value END) AS v{i}, max(CASE WHEN \"column\" = {lit(c)} THEN 1 END) AS s{i}"
        for i, c in enumerate(touched))
    sel = []
    for c in out_cols:
        if c in touched:
            i = touched.index(c)
            sel.append(f"CASE WHEN t.rn = 1 AND w.s{i} = 1 THEN w.v{i} ELSE t.{qi(c)} END AS {qi(c)}")
        else:
            sel.append(f"t.{qi(c)}")
    return f""",
latest AS (SELECT key, "column", arg_max(value, seq) AS value FROM {updates}
           WHERE "column" IN ({known_sql}){blank} GROUP BY key, "column"),
wide AS (SELECT key, {wide_cols} FROM latest GROUP BY key)
SELECT {row_out}{', '.join(sel)}
FROM (SELECT *, row_number() OVER (PARTITION BY {qi(key)} ORDER BY {order}) AS rn FROM {tab}) t
LEFT JOIN wide w ON t.{qi(key)} = w.key AND t.rn = 1"""


PROJECT_KNOWN = [c for c in TAB_COLUMNS["Project Inventory"] if c != "Project Name"]
PIPELINE_KNOWN = [c for c in TAB_COLUMNS["Pipeline"] if c != "Account"]


@query("row_updates", w("projects", "updates") + s_apply("projects", "Project Name", "project_updates", PROJECT_KNOWN,
                                                         PROJECT_OUT, "_row", False, "t._row, "))
def q_row_updates(spark, sf):
    upd = U.form_payload(driver.project_updates(spark, sf, AS_OF), drop_blank=False)
    out = U.apply_updates(cat.stored_projects(spark, sf), "Project Name", upd)
    return out.select(ROW, *[q(c) for c in PROJECT_OUT])


@query("row_updates_pipeline", w("pipeline", "updates") + s_apply(
    "pipeline", "Account", "pipeline_updates", PIPELINE_KNOWN, PIPELINE_OUT, "r1, r2, r3, r4, r5", True,
    "t.r1 AS l_orderkey, t.r2 AS l_linenumber, t.r3 AS l_partkey, t.r4 AS l_suppkey, "))
def q_row_updates_pipeline(spark, sf):
    upd = U.form_payload(driver.pipeline_updates(spark, sf), drop_blank=True)
    out = U.apply_updates(cat.pipeline(spark, sf), "Account", upd)
    return out.select(*[F.col(f"{ROW}.{k}").alias(k) for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      *[q(c) for c in PIPELINE_OUT])


@query("row_update_report", w("projects", "updates") + f""",
keys AS (SELECT key FROM project_updates GROUP BY key),
nv AS (SELECT key, COUNT(DISTINCT "column") AS n_fields FROM project_updates
       WHERE "column" IN ({', '.join(lit(c) for c in PROJECT_KNOWN)}) GROUP BY key)
SELECT k.key,
  CASE WHEN p.key IS NULL THEN 'key not found' WHEN COALESCE(nv.n_fields, 0) = 0 THEN 'no valid field' ELSE 'applied' END AS status,
  CASE WHEN p.key IS NULL THEN 0 ELSE COALESCE(nv.n_fields, 0) END AS n_fields
FROM keys k
LEFT JOIN (SELECT DISTINCT "Project Name" AS key FROM projects WHERE "Project Name" IS NOT NULL) p ON k.key = p.key
LEFT JOIN nv ON k.key = nv.key""")
def q_row_update_report(spark, sf):
    return U.update_report(cat.stored_projects(spark, sf), "Project Name", driver.project_updates(spark, sf, AS_OF))


# -- snapshot ---------------------------------------------------------------

def snapshot_tabs(spark, sf):
    """(name, tab, its first rows) of the 13 tabs in load order; the mapping table is a literal one."""
    tabs = [("Project Inventory", "projects", cat.projects), ("Project Risks", "risks", cat.risks), ("Pipeline", "pipeline", cat.pipeline),
            ("Team Utilization", "staff", cat.staff), ("Talent Gaps", "talent_gaps", cat.talent_gaps), ("Operational Gaps", "operational_gaps", cat.operational_gaps),
            ("Executive Activity", "exec_activity", cat.activity), ("Scenario Model Inputs", "scenario_inputs", cat.scenario_inputs),
            ("Do Nothing Scenario", "do_nothing", cat.do_nothing), ("Proposed Scenario", "proposed", cat.proposed),
            ("Scenario Comparison", "scenario_comparison", cat.scenario_comparison), ("MappingTable", None, lambda s, _: driver.mapping(s)),
            ("Project Observations", "observations", cat.observations)]
    return [(title, df, FirstRows(df) if name else None) for title, name, df in ((t, n, load(spark, sf)) for t, n, load in tabs)]


SNAP_SQL_TABS = [
    ("Project Inventory", "projects", TAB_COLUMNS["Project Inventory"], "_row"),
    ("Project Risks", "risks", ["Project Name", "Risk Description", "Severity", "Impact ($)", "Mitigation Plan", "Owner"],
     "r1, r2, r3, r4, r5"),
    ("Pipeline", "pipeline", TAB_COLUMNS["Pipeline"], "r1, r2, r3, r4, r5"),
    ("Team Utilization", "staff", TAB_COLUMNS["Team Utilization"], "_row"),
    ("Talent Gaps", "talent_gaps", TAB_COLUMNS["Talent Gaps"], "_row"),
    ("Operational Gaps", "operational_gaps", TAB_COLUMNS["Operational Gaps"], "_row"),
    ("Executive Activity", "exec_activity", TAB_COLUMNS["Executive Activity"], "_row"),
    ("Scenario Model Inputs", "scenario_in", ["Scenario", "Assumption", "Value"], "_row"),
    ("Do Nothing Scenario", "do_nothing", TAB_COLUMNS["Do Nothing Scenario"], "_row"),
    ("Proposed Scenario", "proposed", TAB_COLUMNS["Proposed Scenario"], "_row"),
    ("Scenario Comparison", "scenario_comparison", TAB_COLUMNS["Scenario Comparison"], "_row"),
    ("MappingTable", "mapping", TAB_COLUMNS["MappingTable"], "_row"),
    ("Project Observations", "observations", TAB_COLUMNS["Project Observations"], "_row"),
]


def _snap_sql() -> str:
    parts = []
    for i, (name, cte, cols, order) in enumerate(SNAP_SQL_TABS):
        cap = R.snapshot_cap(name)
        text = "concat_ws(' | ', " + ", ".join(f"COALESCE(CAST({qi(c)} AS VARCHAR), '<NA>')" for c in cols) + ")"
        header = lit("Columns: " + ", ".join(cols))
        parts.append(f"""SELECT {i} AS tab_order, {lit(name)} AS tab, CAST(0 AS BIGINT) AS line_no, {lit('Sheet: ' + name)} AS text
  FROM (SELECT COUNT(*) AS n FROM {cte}) WHERE n > 0
UNION ALL SELECT {i}, {lit(name)}, 1, {header} FROM (SELECT COUNT(*) AS n FROM {cte}) WHERE n > 0
UNION ALL SELECT {i}, {lit(name)}, CAST(row_number() OVER (ORDER BY {order}) + 1 AS BIGINT), {text}
  FROM (SELECT * FROM {cte} ORDER BY {order} LIMIT {cap})
UNION ALL SELECT {i}, {lit(name)}, {cap + 2}, '... (showing top {cap} of ' || CAST(n AS VARCHAR) || ' rows)'
  FROM (SELECT COUNT(*) AS n FROM {cte}) WHERE n > {cap}""")
    tabs = ("projects", "risks", "pipeline", "staff", "talent_gaps", "operational_gaps", "exec_activity",
            "scenario_in", "scenario_impacts", "scenario_comparison", "mapping", "observations")
    return with_tabs(*tabs) + ",\nsnap AS (\n" + "\nUNION ALL ".join(parts) + "\n)"


SNAP_SQL = _snap_sql()


@query("context_snapshot", SNAP_SQL + "\nSELECT * FROM snap")
def q_context_snapshot(spark, sf):
    return R.context_snapshot(snapshot_tabs(spark, sf))


def _truncate_sql(mark: str) -> str:
    return SNAP_SQL + f"""
SELECT CAST(length(all_text) AS BIGINT) AS snapshot_chars, length(all_text) > 100000 AS truncated,
  CASE WHEN length(all_text) > 100000 THEN substr(all_text, 1, 100000) || {lit(mark)} ELSE all_text END AS context_text
FROM (SELECT string_agg(text, chr(10) ORDER BY tab_order, line_no) AS all_text FROM snap)"""


@query("context_truncate", _truncate_sql(SNAPSHOT_TRUNCATION_MARK))
def q_context_truncate(spark, sf):
    return R.context_text(R.context_snapshot(snapshot_tabs(spark, sf)))


@query("context_truncate_digest", _truncate_sql(SNAPSHOT_DIGEST_MARK))
def q_context_truncate_digest(spark, sf):
    return R.context_text(R.context_snapshot(snapshot_tabs(spark, sf)), mark=SNAPSHOT_DIGEST_MARK)


# passthrough views: (query, tab function, oracle CTEs, CTE); rows in sheet order, cells as they are
_VIEWS = (
    ("tab_view", cat.talent_gaps, ("talent_gaps",), "talent_gaps"),
    ("view_operational_gaps", cat.operational_gaps, ("operational_gaps",), "operational_gaps"),
    ("view_exec_activity", cat.activity, ("exec_activity",), "exec_activity"),
    ("view_scenario_inputs", cat.scenario_inputs, ("scenario_in",), "scenario_in"),
    ("view_do_nothing", cat.do_nothing, ("scenario_impacts",), "do_nothing"),
    ("view_proposed", cat.proposed, ("scenario_impacts",), "proposed"),
    ("view_scenario_comparison", cat.scenario_comparison, ("scenario_impacts", "scenario_comparison"), "scenario_comparison"),
    ("view_observations", cat.observations, ("observations",), "observations"),
)


def _view(name, tab, ctes, cte):
    query(name, with_tabs(*ctes) + f"\nSELECT * FROM {cte}")(lambda spark, sf: tab(spark, sf).orderBy(ROW))


for _v in _VIEWS:
    _view(*_v)


RISK_COLUMNS = ["Project Name", "Risk Description", "Severity", "Impact ($)", "Mitigation Plan", "Owner"]


@query("view_risk_register", with_tabs("risks") + f"\nSELECT r1, r2, r3, r4, {', '.join(qi(c) for c in RISK_COLUMNS)} FROM risks")
def q_risk_register(spark, sf):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return cat.risks(spark, sf).orderBy(ROW).select(*[F.col(f"{ROW}.{k}").alias(f"r{i + 1}") for i, k in enumerate(keys)], *[q(c) for c in RISK_COLUMNS])


MISSING_TAB = "Sensitivity & Assumption Analysis"


def _workbook_sql() -> str:
    parts = []
    for name, cte, cols, _ in SNAP_SQL_TABS:
        filled = " + ".join(f"count({qi(c)})" for c in cols)
        parts.append(f"SELECT {lit(name)} AS tab, count(*) AS rows, CAST({len(cols)} AS INTEGER) AS columns, CAST({filled} AS BIGINT) AS filled FROM {cte}")
    parts.append(f"SELECT {lit(MISSING_TAB)}, 0, {len(TAB_COLUMNS[MISSING_TAB])}, 0")
    tabs = ("projects", "risks", "pipeline", "staff", "talent_gaps", "operational_gaps", "exec_activity",
            "scenario_in", "scenario_impacts", "scenario_comparison", "mapping", "observations")
    return with_tabs(*tabs) + "\n" + "\nUNION ALL ".join(parts)


@query("load_workbook", _workbook_sql())
def q_load_workbook(spark, sf):
    """All 13 tabs of a load, written to a folder as files and loaded back by name: rows, columns and filled
    cells of each. A tab that is not there is an empty one of its schema."""
    from ..session import new_output_path, wide_writes
    from ..sources.tabs import load_workbook

    folder = new_output_path(spark, "workbook")
    tabs = {name: df for name, df, _ in snapshot_tabs(spark, sf)}
    with wide_writes(spark):
        for name, df in tabs.items():
            df.write.option("compression", "zstd").parquet(f"{folder}/{R.export_slug(name)}")
    out = None
    for name, df in load_workbook(spark, folder, names=[*tabs, MISSING_TAB]).items():
        cols = [c for c in df.columns if c != ROW]
        filled = F.coalesce(F.sum(sum((q(c).isNotNull().cast("bigint") for c in cols), F.lit(0))), F.lit(0)).cast("bigint")
        part = df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).alias("columns"), filled.alias("filled"))
        out = part if out is None else out.unionByName(part)
    return out


@query("export_roundtrip", with_tabs("projects") + "\nSELECT * EXCLUDE (_row) FROM projects")
def q_export_roundtrip(spark, sf):
    return R.export_roundtrip(spark, "Project Inventory", cat.projects(spark, sf))


# -- KPI presentation -------------------------------------------------------

def _kpi_with(*extra):
    return w(*KPI_TABS, *extra, frames=KPI_FRAMES) + ",\nk AS (" + KPI_ALL_SELECT + ")\n"


def _kpis(spark, sf):
    return K.kpi_all(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, sf), cat.typed_risks(spark, sf),
                     cat.typed_staff(spark, sf), cat.typed_activity(spark, sf), AS_OF)


def _scorecard_sql():
    parts = [f"SELECT {lit(i)} AS indicator, CAST({v} AS DOUBLE) AS value, CAST({float(t)!r} AS DOUBLE) AS target, "
             f"{p} AS pct_of_target, CASE WHEN {p} >= 100 THEN 'good' ELSE {lit(bad)} END AS verdict FROM k"
             for i, v, t, p, bad in R.scorecard_rows()]
    return _kpi_with() + "\nUNION ALL ".join(parts)


@query("kpi_scorecard", _scorecard_sql())
def q_kpi_scorecard(spark, sf):
    # only the families the five verdicts read: three scans, no medians or extremes
    p = K.project_frame(cat.typed_projects(spark, sf))
    lf = K.pipeline_frame(cat.typed_pipeline(spark, sf))
    sf_ = K.staff_frame(cat.typed_staff(spark, sf))
    kpis = (K.run(p, [K.f_status(p), K.f_revenue(p), K.f_nps(p)])
            .crossJoin(K.run(lf, [K.f_pipeline_values(lf)]))  # global aggregates: one row each
            .crossJoin(K.run(sf_, [K.f_pulse(sf_)])))
    return R.scorecard_verdicts(kpis)


def _s_part(p) -> str:
    kind = p[0]
    if kind == "lit":
        return lit(p[1])
    if kind == "target":
        return lit(R.target_text(DEFAULT_TARGETS, p[1], p[2]))
    c = p[1]
    if kind == "cur":
        return f"COALESCE('$' || format('{{:,.0f}}', {c}), 'N/A')"
    if kind == "pct":
        return f"COALESCE(format('{{:.1f}}', {c}) || '%', 'N/A')"
    if kind == "pct100":
        return f"COALESCE(format('{{:.1f}}', {c} * CAST(100.0 AS DOUBLE)) || '%', 'N/A')"
    if kind == "num":
        return f"COALESCE(format('{{:,.{p[2]}f}}', CAST({c} AS DOUBLE)), 'N/A')"
    return f"CAST({c} AS VARCHAR)"


def _display_sql():
    parts = []
    for i, (page, label, value, delta) in enumerate(METRIC_CARDS):
        v = " || ".join(_s_part(p) for p in value)
        d = " || ".join(_s_part(p) for p in delta) if delta else "''"
        parts.append(f"SELECT CAST({i} AS INTEGER) AS card_no, {lit(page)} AS page, {lit(label)} AS label, {v} AS value_text, {d} AS delta_text FROM k")
    return _kpi_with() + "\nUNION ALL ".join(parts)


@query("kpi_display", _display_sql())
def q_kpi_display(spark, sf):
    return R.kpi_display(_kpis(spark, sf))


def _router_sql():
    qn = "lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g'))"
    c1 = f"contains({qn}, 'total revenue')"
    c2 = f"(contains({qn}, 'red project') AND (contains({qn}, 'count') OR contains({qn}, 'how many')))"
    a1 = "'Total revenue is ' || COALESCE('$' || format('{:,.0f}', total_revenue), 'N/A') || '.'"
    a2 = "'There are ' || COALESCE(format('{:,.0f}', CAST(red_projects_count AS DOUBLE)), 'N/A') || ' red projects.'"
    return (w("projects", "questions", frames=[PF]) + ",\nk AS (" + s_run("pf", s_status(), s_revenue()) + ")\n"
            + f"SELECT question_id, question, CASE WHEN {c1} THEN 'total_revenue' WHEN {c2} THEN 'red_project_count' END AS rule,\n"
            + f"  CASE WHEN {c1} THEN {a1} WHEN {c2} THEN {a2} END AS answer\nFROM questions CROSS JOIN k")


@query("question_router", _router_sql())
def q_question_router(spark, sf):
    p = K.project_frame(cat.typed_projects(spark, sf))
    kpis = K.run(p, [K.f_status(p), K.f_revenue(p)])
    return R.route_questions(driver.questions(spark, sf), kpis)
