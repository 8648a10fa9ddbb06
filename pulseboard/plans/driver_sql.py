"""The driver-table mapping of ``sources/driver.py`` as DuckDB SQL CTEs.

Only the oracle uses this: each oracle query is ``WITH <ctes> SELECT ...``
over the pre-registered driver views. Text that is later cleaned is built
the same way as on the Spark side.
"""

from __future__ import annotations

from ..sources.driver import AS_OF, mapping_rows
from ..sources.tabs import TAB_COLUMNS
from ..targets import EFFORT_LEVELS, PIPELINE_SCORECARD, PROJECT_SCORECARD, SCENARIO_LABELS

D = f"DATE '{AS_OF.isoformat()}'"


def lit(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def pick(idx: str, options) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {lit(o)}" for i, o in enumerate(options)) + " END"


def fixed(units: str, decimals: int) -> str:
    p = 10 ** decimals
    return f"(CAST(({units}) // {p} AS VARCHAR) || '.' || lpad(CAST(({units}) % {p} AS VARCHAR), {decimals}, '0'))"


def money(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', {x}))"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _projects() -> str:
    nine = [(n, o) for n, o in PROJECT_SCORECARD if n != "Team Resourcing"]
    cards = {n: pick(f"((k // {3 ** i}) % {len(o)})", o) for i, (n, o) in enumerate(nine)}
    res = dict(PROJECT_SCORECARD)["Team Resourcing"]
    cols = {
        "Project Name": "'Project ' || CAST(k AS VARCHAR)",
        "Client": "c_name",
        "Project Start Date": "CAST(sd AS VARCHAR)",
        "Project End Date": "CAST(ed AS VARCHAR)",
        "Revenue": f"CASE WHEN k % 17 = 0 THEN NULL WHEN k % 41 = 0 THEN 'USD 0.004' WHEN k % 43 = 0 THEN 'Q3 2025' || chr(160) "
                   f"ELSE {money('o_totalprice')} END",
        "Margin": "CAST(NULL AS VARCHAR)",
        "Status (R/Y/G)": "CASE WHEN k % 23 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN CASE WHEN k % 3 = 0 THEN 'g' || chr(160) ELSE 'G ' END "
                          "WHEN o_orderstatus = 'O' THEN CASE WHEN k % 5 = 0 THEN chr(9) || 'y' || chr(10) ELSE 'y' END "
                          "WHEN o_orderstatus = 'P' THEN CASE WHEN k % 2 = 0 THEN 'R' || chr(9) ELSE 'R' END END",
        "Key Issues": "o_orderpriority",
        "Next Steps": "CASE WHEN k % 22 = 0 THEN 'Say \"now\", then' || chr(10) || 'review' WHEN k % 2 = 0 THEN 'Review plan' END",
        "Executive Support Required": "CASE WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END",
        "eNPS": "CAST(k % 101 - 20 AS VARCHAR)",
        "Next Opp First Discussion Date": "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(ed + CAST(k % 90 - 10 AS INTEGER) AS VARCHAR) END",
        "Last Sponsor Checkin Date": f"CASE WHEN k % 7 = 0 THEN NULL ELSE CAST({D} - CAST(k % 60 AS INTEGER) AS VARCHAR) END",
        "Sponsor Checkin Notes": "CASE WHEN k % 5 = 0 THEN NULL ELSE 'note' END",
        **cards,
        "Team Resourcing": f"CASE WHEN k % 29 = 0 THEN NULL ELSE {pick('(k % 5)', res)} END",
        "Project Health Score": fixed("(k * 37) % 105000", 3),
        "Health Band": "CAST(NULL AS VARCHAR)",
        "Delivery Relational Effort": pick("(k % 3)", EFFORT_LEVELS),
        "Expansion Yield Tier": pick("((k // 3) % 3)", EFFORT_LEVELS),
        "Delivery Efficiency Score": "CAST((k * 53) % 101 AS VARCHAR)",
        "Total Project Score": fixed("((k * 37) % 105000) * 7 + ((k * 53) % 101) * 3000", 4),
    }
    sel = ",\n    ".join(f"{cols[n]} AS {qi(n)}" for n in TAB_COLUMNS["Project Inventory"])
    return f"""p_base AS (
  SELECT o.*, o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS sd,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
              ELSE CAST(o.o_orderdate AS DATE) + CAST(30 + o.o_orderkey % 400 AS INTEGER) END AS ed,
         c.c_name
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
projects AS (
  SELECT {sel},
    k AS _row
  FROM p_base
)"""


def _pipeline() -> str:
    cards = {n: pick(f"(((pk // {5 ** i}) + ln) % {len(o)})", o) for i, (n, o) in enumerate(PIPELINE_SCORECARD)}
    pm = "(CAST(l_quantity AS BIGINT) * 2000 - pk % 1000)"
    cols = {
        "Account": "s_name",
        "Opportunity Created Date": "CAST(shd AS VARCHAR)",
        "Last Touchpoint Date": f"CAST({D} - CAST(pk % 45 AS INTEGER) AS VARCHAR)",
        "Next Touchpoint Date": f"CAST({D} + CAST(pk % 60 - 30 AS INTEGER) AS VARCHAR)",
        "Closed Won Date": "CASE WHEN ln = 7 THEN NULL ELSE CAST(shd + CAST(pk % 200 - 20 AS INTEGER) AS VARCHAR) END",
        "Support Focus Type": "'Tier ' || CAST(pk % 3 + 1 AS VARCHAR)",
        "Percieved Annual AMO": "'$' || CAST(CAST(l_quantity * 1000 AS BIGINT) AS VARCHAR)",
        "Open Pipeline_Active Work": money("l_extendedprice"),
        "Horizon": "CASE l_returnflag WHEN 'A' THEN 'Near-term' WHEN 'N' THEN 'Mid-term' WHEN 'R' THEN 'Long-term' END",
        "Pursuit Tier": "CASE WHEN sk % 31 = 0 THEN NULL ELSE (CASE WHEN sk % 2 = 0 THEN 'Tier ' ELSE 'TIER ' END) || CAST(sk % 3 + 1 AS VARCHAR) END",
        "Notes": "'Notes ' || CAST(l_orderkey AS VARCHAR)",
        "Help Needed": "CASE WHEN pk % 4 = 0 THEN 'Executive intro' END",
        "Actions": "CASE WHEN pk % 3 = 0 THEN 'Follow up' END",
        "Internal Pursuit Team": "CAST(NULL AS VARCHAR)",
        "Key Client Contacts": "'Contact ' || CAST(pk AS VARCHAR)",
        "Win Themes": "CAST(NULL AS VARCHAR)",
        "Known Competitors": "CAST(NULL AS VARCHAR)",
        "Deal Registered YN": "CASE l_linestatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END",
        "MSA/ICA Status": "CAST(NULL AS VARCHAR)",
        **cards,
        "Pipeline Score": fixed(pm, 3),
        "Score Band": "CAST(NULL AS VARCHAR)",
        "Pre-Sales Effort Level": pick("(pk % 3)", EFFORT_LEVELS),
        "Revenue Potential Tier": pick("(sk % 3)", EFFORT_LEVELS),
        "Relational Efficiency Score": "CAST((sk * 53) % 101 AS VARCHAR)",
        "Total Deal Score": fixed(f"{pm} * 7 + ((sk * 53) % 101) * 3000", 4),
    }
    sel = ",\n    ".join(f"{cols[n]} AS {qi(n)}" for n in TAB_COLUMNS["Pipeline"])
    return f"""l_base AS (
  SELECT l.*, l.l_partkey AS pk, l.l_suppkey AS sk, l.l_linenumber AS ln,
         CAST(l.l_shipdate AS DATE) AS shd, s.s_name
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
pipeline AS (
  SELECT {sel},
    l_orderkey AS r1, l_linenumber AS r2, l_partkey AS r3, l_suppkey AS r4, l_shipdate AS r5
  FROM l_base
)"""


def _risks() -> str:
    return f"""risks AS (
  SELECT 'Project ' || CAST(l_orderkey AS VARCHAR) AS "Project Name",
    'Return flag ' || l_returnflag AS "Risk Description",
    CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'High'
         WHEN l_returnflag = 'A' THEN 'medium' WHEN l_returnflag = 'N' THEN 'LOW' END AS "Severity",
    {money('l_extendedprice')} AS "Impact ($)",
    CAST(NULL AS VARCHAR) AS "Mitigation Plan",
    'Owner ' || CAST(l_suppkey AS VARCHAR) AS "Owner",
    l_orderkey AS r1, l_linenumber AS r2, l_partkey AS r3, l_suppkey AS r4, l_shipdate AS r5
  FROM lineitem
)"""


def _staff() -> str:
    return """s_assign AS (
  SELECT l_suppkey, string_agg(DISTINCT p, ', ' ORDER BY p) AS assignments
  FROM (SELECT l_suppkey, 'Project ' || CAST(l_orderkey AS VARCHAR) AS p FROM lineitem)
  GROUP BY l_suppkey
),
staff AS (
  SELECT s_name AS "Employee Name",
    CASE WHEN s_suppkey % 10 = 0 THEN 'Executive Director' WHEN s_suppkey % 10 = 1 THEN 'executive sponsor'
         ELSE 'Data Engineer' END AS "Role",
    a.assignments AS "Project Assignments",
    CAST(40 + (s_suppkey * 7) % 80 AS VARCHAR) || '%' AS "Utilization (%)",
    '$' || CAST(s_suppkey % 150 + 100 AS VARCHAR) AS "Billable Rate ($/hr)",
    '$' || CAST(s_suppkey % 500 + 1000 AS VARCHAR) AS "Strategic Opportunity Cost ($/week)",
    CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(s_suppkey % 11 AS VARCHAR) END AS "Latest Pulse Score",
    s_suppkey AS _row
  FROM supplier s LEFT JOIN s_assign a ON s.s_suppkey = a.l_suppkey
)"""


def _exec() -> str:
    return f"""exec_activity AS (
  SELECT 'Activity ' || CAST(event_id AS VARCHAR) AS "Activity",
    event_type AS "Type (Delivery/Sales/Ops)",
    CAST(user_id % 20 AS VARCHAR) AS "Time Spent Weekly (hrs)",
    {money('value')} AS "Strategic Cost ($)",
    CAST(NULL AS VARCHAR) AS "Delegate to?",
    event_id AS _row
  FROM events
)"""


def _talent() -> str:
    return f"""talent_gaps AS (
  SELECT p_name AS "Skill/Role Needed", {pick('(p_size % 3)', ('High', 'Medium', 'Low'))} AS "Gap Impact (High/Medium/Low)",
    p_brand AS "Urgency", CAST({D} + CAST(p_size AS INTEGER) AS VARCHAR) AS "Target Hire Date",
    p_type AS "Hiring Owner", p_partkey AS _row
  FROM part
)"""


def _opgaps() -> str:
    return f"""operational_gaps AS (
  SELECT c_mktsegment || ' backlog' AS "Operational Issue",
    {pick('(c_custkey % 3)', ('High', 'Medium', 'Low'))} AS "Severity (High/Medium/Low)",
    {pick('((c_custkey // 3) % 3)', ('Daily', 'Weekly', 'As-needed'))} AS "Frequency",
    'Review process' AS "Recommended Process/Solution", c_name AS "Owner", c_custkey AS _row
  FROM customer
)"""


def _observations() -> str:
    return """observations AS (
  SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date", 'Project ' || CAST(o_orderkey AS VARCHAR) AS "Project",
    o_orderpriority AS "Observation", o_orderkey AS _row
  FROM orders
)"""


def _scenario_inputs() -> str:
    m = money("o_totalprice")
    return f"""scenario_in AS (
  SELECT o_custkey AS "Scenario", {pick('(o_orderkey % 11)', SCENARIO_LABELS)} AS "Assumption",
    CASE o_orderkey % 11
      WHEN 0 THEN CASE WHEN o_orderkey % 89 = 0 THEN '$n/a' ELSE '$' || CAST(o_orderkey % 300 + 200 AS VARCHAR) END
      WHEN 1 THEN CAST(o_orderkey % 20 + 5 AS VARCHAR)
      WHEN 2 THEN '$' || CAST(o_orderkey % 200 + 100 AS VARCHAR)
      WHEN 3 THEN CAST(o_orderkey % 30 + 10 AS VARCHAR)
      WHEN 4 THEN {m}
      WHEN 5 THEN CAST(o_orderkey % 60 AS VARCHAR) || '%'
      WHEN 6 THEN '$' || CAST(o_orderkey % 100000 + 50000 AS VARCHAR)
      WHEN 7 THEN CAST(o_orderkey % 100 AS VARCHAR) || '%'
      WHEN 8 THEN {m}
      WHEN 9 THEN CASE WHEN o_orderkey % 97 = 0 THEN '1,000' ELSE CAST(o_orderkey % 13 + 40 AS VARCHAR) END
      ELSE '$' || CAST(o_orderkey % 50000 + 80000 AS VARCHAR) END AS "Value",
    o_orderkey AS _row
  FROM orders
)"""


def _scenario_overrides() -> str:
    return """scenario_over AS (
  SELECT c_custkey AS "Scenario", 'Work Weeks in a year' AS "Assumption", CAST(c_custkey % 13 + 40 AS VARCHAR) AS "Value" FROM customer
  UNION ALL
  SELECT c_custkey, 'VP Hours Weekly on Delivery', CAST(c_nationkey AS VARCHAR) FROM customer
)"""


def _scenario_impacts() -> str:
    return f"""do_nothing AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'Project Recovery Costs' ELSE 'Lost Sales (VP involvement)' END AS "Category",
    'Project ' || CAST(o_orderkey AS VARCHAR) AS "Calculation Details",
    '-' || format('{{:,.2f}}', o_totalprice) AS "Annualized Impact ($)", o_orderkey AS _row
  FROM orders WHERE o_orderstatus <> 'F'
),
proposed AS (
  SELECT o_orderpriority AS "Category", 'Project ' || CAST(o_orderkey AS VARCHAR) AS "Calculation Details",
    {money('o_totalprice')} AS "Annualized Impact ($)", o_orderkey AS _row
  FROM orders WHERE o_orderstatus = 'F'
)"""


def _scenario_comparison() -> str:
    """Needs scenario_impacts before it. Totals from the order prices, not from the tabs' text."""
    cents = "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DECIMAL(38,2)) / 100"
    text = lambda x: f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs({x})))"
    return f"""sc_sums AS (
  SELECT -COALESCE(CAST(SUM(CASE WHEN o_orderstatus <> 'F' THEN {cents} END) AS DOUBLE), 0.0) AS nothing,
         COALESCE(CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN {cents} END) AS DOUBLE), 0.0) AS plan
  FROM orders
),
scenario_comparison AS (
  SELECT 'Do Nothing' AS "Scenario", {text('nothing')} AS "Total Annualized Impact ($)", {text('(nothing - nothing)')} AS "Net Incremental Value ($)", CAST(0 AS BIGINT) AS _row FROM sc_sums
  UNION ALL SELECT 'Proposed', {text('plan')}, {text('(plan - nothing)')}, 1 FROM sc_sums
)"""


def _mapping() -> str:
    vals = ",\n    ".join(
        f"({lit(t)}, {lit(qn)}, {lit(v)}, {lit(s)}, {lit(k)}, {r})" for t, qn, v, s, k, r in mapping_rows())
    return f"""mapping AS (
  SELECT * FROM (VALUES
    {vals}) AS m("Tab", "Question", "Value", "Score", "Key", _row)
)"""


def _questions() -> str:
    return """questions AS (
  SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'
  UNION ALL SELECT -1, 'What is TOTAL revenue?'
  UNION ALL SELECT -2, 'how many red projects'
  UNION ALL SELECT -3, 'red project list'
  UNION ALL SELECT -4, 'total revenue and red project count'
)"""


def _updates() -> str:
    def u(cond, key, col, val, off):
        return (f"SELECT {key} AS key, {lit(col)} AS \"column\", {val} AS value, o_orderkey * 10 + {off} AS seq "
                f"FROM orders WHERE {cond}")
    name = "'Project ' || CAST(o_orderkey AS VARCHAR)"
    parts = [
        u("o_orderkey % 13 = 0", name, "Status (R/Y/G)", "'G'", 0),
        u("o_orderkey % 13 = 0", name, "Sponsor Checkin Notes", "''", 1),
        u("o_orderkey % 13 = 0", name, "Last Sponsor Checkin Date", lit(AS_OF.isoformat()), 2),
        u("o_orderkey % 26 = 0", name, "Budget Owner", "'x'", 3),
        u("o_orderkey % 39 = 0", "'Archived ' || CAST(o_orderkey AS VARCHAR)", "Status (R/Y/G)", "'R'", 4),
        u("o_orderkey % 65 = 0", name, "Status (R/Y/G)", "'Y'", 5),
        u("o_orderkey % 13 = 1", name, "Budget Owner", "'y'", 6),
    ]
    pp = [
        f"SELECT s_name AS key, {lit(c)} AS \"column\", {v} AS value, s_suppkey * 10 + {i} AS seq FROM supplier WHERE s_suppkey % 3 = 0"
        for i, (c, v) in enumerate([("Horizon", "'Near-term'"), ("Notes", "''"),
                                    ("Percieved Annual AMO", "CAST((s_suppkey % 50) * 1000 AS VARCHAR)"),
                                    ("Deal Registered YN", "'Y'")])
    ]
    return ("project_updates AS (\n  " + "\n  UNION ALL ".join(parts) + "\n),\n"
            "pipeline_updates AS (\n  " + "\n  UNION ALL ".join(pp) + "\n)")


def _sens_ranges() -> str:
    rows = []
    for i, label in enumerate(SCENARIO_LABELS[:9]):
        rng = "n/a" if i == 8 else f"\u00b1{5 * (i % 4 + 1)}%"
        rows.append(f"({lit(label)}, {lit(rng)}, {i})")
    return ("sens_ranges AS (SELECT * FROM (VALUES " + ", ".join(rows)
            + ') AS t("Assumption/Scenario Input", "Sensitivity Range", _row))')


CTE_BUILDERS = {
    "sens_ranges": _sens_ranges,
    "updates": _updates,
    "projects": _projects,
    "pipeline": _pipeline,
    "risks": _risks,
    "staff": _staff,
    "exec_activity": _exec,
    "talent_gaps": _talent,
    "operational_gaps": _opgaps,
    "observations": _observations,
    "scenario_in": _scenario_inputs,
    "scenario_over": _scenario_overrides,
    "scenario_impacts": _scenario_impacts,
    "scenario_comparison": _scenario_comparison,
    "mapping": _mapping,
    "questions": _questions,
}


def with_tabs(*names: str) -> str:
    """``WITH`` clause holding the CTEs of the named tabs (no trailing comma)."""
    return "WITH " + ",\n".join(CTE_BUILDERS[n]() for n in names)
