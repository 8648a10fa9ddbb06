"""Scenario-model queries with their oracle SQL.

Scenarios come from the driver tables: one scenario per customer whose
assumption rows are its orders (``sources/driver.scenario_inputs``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenario as SC
from ..sources import driver
from ..targets import SCENARIO_DEFAULTS, SCENARIO_LABELS
from .catalog import query
from .driver_sql import lit, with_tabs
from .sqlfn import num

N = len(SCENARIO_LABELS)
BY = ("Scenario",)


def dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def s_parse(v: str):
    t = f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    pct = f"COALESCE(TRY_CAST(replace({t}, '%', '') AS DOUBLE), 0.0)"
    cur = f"COALESCE(TRY_CAST(replace(replace({t}, '$', ''), ',', '') AS DOUBLE), 0.0)"
    txt = f"TRY_CAST({t} AS DOUBLE)"
    num = f"CASE WHEN ends_with({t}, '%') THEN {pct} WHEN starts_with({t}, '$') THEN {cur} ELSE {txt} END"
    ok = f"COALESCE(ends_with({t}, '%') OR starts_with({t}, '$') OR {txt} IS NOT NULL, false)"
    return num, ok


def s_inputs(src: str, keys: str) -> str:
    """Deduplicated, parsed inputs: keys..., Assumption, Value, value_num, parsed_ok."""
    num, ok = s_parse('"Value"')
    k = f"{keys}, " if keys else ""
    return (f"SELECT *, {num} AS value_num, {ok} AS parsed_ok FROM (SELECT {k}\"Assumption\", "
            f"arg_max(\"Value\", _row) AS \"Value\" FROM {src} WHERE \"Assumption\" IS NOT NULL "
            f"GROUP BY {k}\"Assumption\")")


def s_wide(src: str, keys: str) -> str:
    aggs = []
    for i, label in enumerate(SCENARIO_LABELS):
        aggs += [f"max(CASE WHEN \"Assumption\" = {lit(label)} THEN value_num END) AS n{i}",
                 f"max(CASE WHEN \"Assumption\" = {lit(label)} THEN CASE WHEN parsed_ok THEN 1 ELSE 0 END END) AS k{i}"]
    cols, bad = [], []
    for i, label in enumerate(SCENARIO_LABELS):
        cols.append(f"CASE WHEN k{i} IS NOT NULL THEN n{i} ELSE {dbl(SCENARIO_DEFAULTS.get(label, 0.0))} END AS v{i}")
        cols.append(f"k{i} IS NOT NULL AS has{i}")
        bad.append(f"(k{i} IS NOT NULL AND k{i} = 0)")
    k = f"{keys}, " if keys else ""
    grp = f" GROUP BY {keys}" if keys else ""
    return (f"SELECT {k}{', '.join(cols)}, ({' OR '.join(bad)}) AS failed FROM "
            f"(SELECT {k}{', '.join(aggs)} FROM {src}{grp})")


def s_calc(v, failed: str) -> dict:
    m1, h = dbl(-1.0), dbl(100.0)
    at_risk = f"({v[7]} / {h})"
    r = {
        "lost_sales": f"{m1} * {v[1]} * {v[0]} * {v[9]}",
        "strategic_loss": f"{m1} * {v[3]} * {v[2]} * {v[9]}",
        "project_recovery_costs": f"{m1} * {v[8]} * {at_risk}",
        "employee_turnover_impact": f"{dbl(-3.0)} * {v[6]}",
        "regained_vp_selling_time": f"{dbl(12.0)} * {v[0]} * {v[9]}",
        "strategic_delivery_capacity_recovered": f"{dbl(15.0)} * {v[2]} * {v[9]}",
        "project_health_improvement": f"{dbl(0.5)} * {v[8]} * {at_risk}",
        "improved_retention": f"{dbl(2.0)} * {v[6]}",
        "cost_of_chief_of_staff_salary": f"{m1} * {v[10]}",
    }
    r = {k: f"({x})" for k, x in r.items()}
    r["total_negative_impact"] = ("(" + " + ".join(r[c] for c in SC.CATEGORY_COLS[:4]) + ")")
    r["total_positive_impact"] = ("(" + " + ".join(r[c] for c in SC.CATEGORY_COLS[4:9]) + ")")
    return {k: f"(CASE WHEN {failed} THEN 0.0 ELSE {x} END)" for k, x in r.items()}


def s_calc_frame(wide: str, keys: str) -> str:
    r = s_calc([f"v{i}" for i in range(N)], "failed")
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}{', '.join(f'{r[c]} AS {c}' for c in SC.CATEGORY_COLS)}, failed FROM ({wide})"


# -- Spark side helpers --------------------------------------------------------

def _inputs(spark, sf):
    from . import catalog as cat

    return cat.scenario_inputs(spark, sf)


SI = s_inputs("scenario_in", '"Scenario"')


@query("scenario_inputs", with_tabs("scenario_in") + "\n" + SI)
def q_scenario_inputs(spark, sf):
    return SC.scenario_inputs(_inputs(spark, sf), BY)


@query("scenario_calc", with_tabs("scenario_in") + "\n" + s_calc_frame(s_wide(f"({SI})", '"Scenario"'), '"Scenario"'))
def q_scenario_calc(spark, sf):
    return SC.scenario_calc(SC.scenario_inputs(_inputs(spark, sf), BY), BY)


def _prop_inputs_sql():
    num, ok = s_parse("COALESCE(o.\"Value\", b.\"Value\")")
    return (f"SELECT b.\"Scenario\", b.\"Assumption\", COALESCE(o.\"Value\", b.\"Value\") AS \"Value\", "
            f"{num} AS value_num, {ok} AS parsed_ok FROM ({SI}) b LEFT JOIN scenario_over o "
            "ON b.\"Scenario\" = o.\"Scenario\" AND b.\"Assumption\" = o.\"Assumption\"")


def _compare_sql():
    base = s_calc_frame(s_wide(f"({SI})", '"Scenario"'), '"Scenario"')
    prop = s_calc_frame(s_wide(f"({_prop_inputs_sql()})", '"Scenario"'), '"Scenario"')
    parts = []
    for c in SC.CATEGORY_COLS:
        name = SC.CATEGORY_NAME[c]
        rank = 2 if "Total" in name else (1 if any(w in name for w in ("Recovered", "Improved", "Regained")) else 0)
        parts.append(f"SELECT b.\"Scenario\", {lit(name)} AS category, {rank} AS sort_order, b.{c} AS do_nothing, "
                     f"p.{c} AS proposed, p.{c} - b.{c} AS difference FROM base b JOIN prop p ON b.\"Scenario\" = p.\"Scenario\"")
    return (with_tabs("scenario_in", "scenario_over") + f",\nbase AS ({base}),\nprop AS ({prop})\n"
            + "\nUNION ALL ".join(parts))


@query("scenario_compare", _compare_sql())
def q_scenario_compare(spark, sf):
    base = SC.scenario_inputs(_inputs(spark, sf), BY)
    return SC.scenario_compare_overrides(base, driver.scenario_overrides(spark, sf), BY)


def _sweep_sql():
    wide = s_wide(f"({s_inputs('scenario_in', '')})", "")
    base_r = s_calc([f"v{i}" for i in range(N)], "failed")
    base_net = f"({base_r['total_positive_impact']} + {base_r['total_negative_impact']})"
    v = [f"v{i}" for i in range(N)]
    i_weeks, i_risk = SCENARIO_LABELS.index("Work Weeks in a year"), SCENARIO_LABELS.index("% Projects at Risk")
    v[i_weeks] = f"(CASE WHEN has{i_weeks} THEN CAST(weeks AS DOUBLE) ELSE v{i_weeks} END)"
    v[i_risk] = f"(CASE WHEN has{i_risk} THEN at_risk_pct ELSE v{i_risk} END)"
    r = s_calc(v, "failed")
    net = f"({r['total_positive_impact']} + {r['total_negative_impact']})"
    return (with_tabs("scenario_in") + f""",
gw AS (SELECT *, {base_net} AS base_net FROM ({wide})),
sweep AS (
  SELECT o_custkey AS "Scenario", CAST(w.weeks AS INTEGER) AS weeks,
    COUNT(CASE WHEN o_orderstatus <> 'F' THEN 1 END) * {dbl(100.0)} / COUNT(*) AS at_risk_pct
  FROM orders CROSS JOIN range(40, 53) w(weeks) GROUP BY o_custkey, w.weeks
)
SELECT "Scenario", weeks, {r['total_negative_impact']} AS total_negative_impact,
  {r['total_positive_impact']} AS total_positive_impact, {net} AS net_impact, {net} - base_net AS net_vs_baseline
FROM sweep CROSS JOIN gw""")


@query("scenario_sweep", _sweep_sql())
def q_scenario_sweep(spark, sf):
    base = SC.scenario_inputs(_inputs(spark, sf).drop("Scenario"))
    o = driver.read(spark, sf, "orders")
    share = o.groupBy("o_custkey").agg(
        (F.count(F.when(F.col("o_orderstatus") != "F", 1)) * 100.0 / F.count(F.lit(1))).alias("at_risk_pct"))
    sweep = share.select(F.col("o_custkey").alias("Scenario"), F.explode(F.sequence(F.lit(40), F.lit(52))).alias("weeks"),
                         "at_risk_pct")
    return SC.scenario_sweep(base, sweep, ("Scenario", "weeks"),
                             {"Work Weeks in a year": "weeks", "% Projects at Risk": "at_risk_pct"})


def _sensitivity_sql(spread=0.10):
    wide = s_wide(f"({SI})", '"Scenario"')
    rr = ("(SELECT \"Assumption/Scenario Input\" AS a, arg_min(TRY_CAST(regexp_extract(\"Sensitivity Range\", "
          "'([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) / CAST(100.0 AS DOUBLE), _row) AS r FROM sens_ranges GROUP BY 1)")
    parts = []
    for i, label in enumerate(SCENARIO_LABELS):
        rate = f"COALESCE(rr.r, {dbl(spread)})"
        lo, hi = f"(CAST(1.0 AS DOUBLE) - {rate})", f"(CAST(1.0 AS DOUBLE) + {rate})"

        def at(f):
            v = [f"(v{j} * {f})" if j == i else f"v{j}" for j in range(N)]
            r = s_calc(v, "failed")
            return f"({r['total_positive_impact']} + {r['total_negative_impact']})"
        parts.append(f"SELECT \"Scenario\", {lit(label)} AS assumption, v{i} AS base_value, v{i} * {lo} AS low_value, "
                     f"v{i} * {hi} AS high_value, {at(lo)} AS impact_low, {at(hi)} AS impact_high "
                     f"FROM w LEFT JOIN {rr} rr ON rr.a = {lit(label)} WHERE has{i}")
    return with_tabs("scenario_in", "sens_ranges") + f",\nw AS ({wide})\n" + "\nUNION ALL ".join(parts)


@query("sensitivity", _sensitivity_sql())
def q_sensitivity(spark, sf):
    return SC.sensitivity(SC.scenario_inputs(_inputs(spark, sf), BY), BY, ranges=driver.sensitivity_ranges(spark))


@query("scenario_totals", with_tabs("scenario_impacts") + f"""
, g AS (
  SELECT scenario, COALESCE(CAST(SUM(CAST(x AS DECIMAL(26,2))) AS DOUBLE), 0.0) AS total_annualized_impact FROM (
    SELECT 'Do Nothing' AS scenario, {num('"Annualized Impact ($)"')} AS x FROM do_nothing
    UNION ALL
    SELECT 'Proposed', {num('"Annualized Impact ($)"')} FROM proposed
  ) GROUP BY scenario
)
SELECT scenario, total_annualized_impact,
  total_annualized_impact - COALESCE((SELECT max(CASE WHEN scenario = 'Do Nothing' THEN total_annualized_impact END) FROM g), 0.0)
    AS net_incremental_value
FROM g""")
def q_scenario_totals(spark, sf):
    from . import catalog as cat

    return SC.scenario_totals(cat.typed_do_nothing(spark, sf), cat.typed_proposed(spark, sf))
