"""What-if scenario model, evaluated for any number of scenarios in one job.

Inputs are long rows (scenario keys..., Assumption, Value) - the Scenario
Model Inputs tab, with optional scenario key columns. A repeated label keeps
its last row in sheet order. Values parse as in the reference: text ending
with ``%`` or starting with ``$`` becomes a number (0.0 when it does not
parse); any other text must parse as a number when the model uses it, and a
used label that does not parse empties the whole scenario (all results 0).
Everything is a column expression over one row per scenario: no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import FAR, Sum, aggregate
from ..sources.tabs import ROW, q, with_default
from ..targets import SCENARIO_CATEGORIES, SCENARIO_DEFAULTS, SCENARIO_LABELS
from ..functions import clean as C
from .kpis import impact_frame

CATEGORY_COLS = (
    "lost_sales", "strategic_loss", "project_recovery_costs", "employee_turnover_impact",
    "regained_vp_selling_time", "strategic_delivery_capacity_recovered", "project_health_improvement",
    "improved_retention", "cost_of_chief_of_staff_salary", "total_negative_impact", "total_positive_impact",
)
CATEGORY_NAME = dict(zip(CATEGORY_COLS, SCENARIO_CATEGORIES))


def parse_value(value: Column):
    """(number, ok) of one assumption value."""
    t = C.strip(value)
    is_pct, is_cur = t.endswith("%"), t.startswith("$")
    number = lambda c: C.strict_double(C.strip(c))
    pct = F.coalesce(number(F.replace(t, F.lit("%"), F.lit(""))), F.lit(0.0))
    cur = F.coalesce(number(F.translate(t, "$,", "")), F.lit(0.0))
    txt = number(t)
    num = F.when(is_pct, pct).when(is_cur, cur).otherwise(txt)
    ok = F.coalesce(is_pct | is_cur | txt.isNotNull(), F.lit(False))
    return num, ok


def scenario_inputs(df: DataFrame, by=()) -> DataFrame:
    """Last value per (scenario, label), parsed: by..., Assumption, Value, value_num, parsed_ok."""
    keys = [q(b) for b in by] + [q("Assumption")]
    df = with_default(with_default(df, "Value"), "Assumption")
    df = df.withColumn("Value", q("Value").cast("string"))
    last = df.where(q("Assumption").isNotNull()).groupBy(*keys).agg(F.max_by(q("Value"), F.col(ROW)).alias("Value"))
    num, ok = parse_value(F.col("Value"))
    return last.select(*keys, "Value", num.alias("value_num"), ok.alias("parsed_ok"))


def _wide_aggs(prefix: str, num: str, ok: str) -> list:
    lab = q("Assumption")
    aggs = []
    for i, label in enumerate(SCENARIO_LABELS):
        aggs += [F.max(F.when(lab == label, F.col(num))).alias(f"{prefix}n{i}"),
                 F.max(F.when(lab == label, F.when(F.col(ok), 1).otherwise(0))).alias(f"{prefix}k{i}")]
    return aggs


def _wide_columns(prefix: str) -> list:
    cols, bad = [], None
    for i, label in enumerate(SCENARIO_LABELS):
        present = F.col(f"{prefix}k{i}").isNotNull()
        cols += [F.when(present, F.col(f"{prefix}n{i}")).otherwise(F.lit(SCENARIO_DEFAULTS.get(label, 0.0))).alias(f"{prefix}v{i}"),
                 present.alias(f"{prefix}has{i}")]
        b = present & (F.col(f"{prefix}k{i}") == 0)
        bad = b if bad is None else (bad | b)
    return [*cols, bad.alias(f"{prefix}failed")]


def wide_inputs(inputs: DataFrame, by=()) -> DataFrame:
    """One row per scenario: v0..v10 (label value or default), has0..has10 and ``failed``.

    Conditional aggregates over the known labels (no pivot, no extra job to
    find pivot values); a missing label takes its default.
    """
    g = inputs.groupBy(*[q(b) for b in by]) if by else inputs.groupBy()
    return g.agg(*_wide_aggs("", "value_num", "parsed_ok")).select(*[q(b) for b in by], *_wide_columns(""))


def calc(v, failed: Column) -> dict:
    """The 9 components and 2 totals from input Columns ``v[0..10]`` (label order). The factors
    -3, 12, 15, 0.5 and 2 of the model."""
    vp_hourly, vp_hours, head_hourly, head_hours = v[0], v[1], v[2], v[3]
    turnover, at_risk, rev_risk, weeks, salary = v[6], v[7] / 100.0, v[8], v[9], v[10]
    r = {
        "lost_sales": F.lit(-1.0) * vp_hours * vp_hourly * weeks,
        "strategic_loss": F.lit(-1.0) * head_hours * head_hourly * weeks,
        "project_recovery_costs": F.lit(-1.0) * rev_risk * at_risk,
        "employee_turnover_impact": F.lit(-3.0) * turnover,
        "regained_vp_selling_time": F.lit(12.0) * vp_hourly * weeks,
        "strategic_delivery_capacity_recovered": F.lit(15.0) * head_hourly * weeks,
        "project_health_improvement": F.lit(0.5) * rev_risk * at_risk,
        "improved_retention": F.lit(2.0) * turnover,
        "cost_of_chief_of_staff_salary": F.lit(-1.0) * salary,
    }
    r["total_negative_impact"] = (r["lost_sales"] + r["strategic_loss"] + r["project_recovery_costs"]
                                  + r["employee_turnover_impact"])
    r["total_positive_impact"] = (r["regained_vp_selling_time"] + r["strategic_delivery_capacity_recovered"]
                                  + r["project_health_improvement"] + r["improved_retention"]
                                  + r["cost_of_chief_of_staff_salary"])
    return {k: F.when(failed, F.lit(0.0)).otherwise(c) for k, c in r.items()}


def scenario_calc(inputs: DataFrame, by=()) -> DataFrame:
    """One row per scenario with the 11 result columns and the ``failed`` flag."""
    w = wide_inputs(inputs, by)
    v = [F.col(f"v{i}") for i in range(len(SCENARIO_LABELS))]
    res = calc(v, F.col("failed"))
    return w.select(*[q(b) for b in by], *[res[c].alias(c) for c in CATEGORY_COLS], "failed")


def override_inputs(base: DataFrame, overrides: DataFrame, by=()) -> DataFrame:
    """Proposed inputs: the baseline with changed values (one override per scenario and label).

    An override of a label the baseline lacks is ignored, as a form has no
    field for it. Works for any number of scenarios in one equi join.
    """
    keys = list(by) + ["Assumption"]
    o = overrides.select(*[q(k) for k in keys], q("Value").alias("__new"))
    j = base.drop("value_num", "parsed_ok").join(o, keys, "left")
    v = F.coalesce(F.col("__new"), q("Value"))
    num, ok = parse_value(v)
    return j.select(*[q(k) for k in keys], v.alias("Value"), num.alias("value_num"), ok.alias("parsed_ok"))


def _order_rank(cat: Column) -> Column:
    return (F.when(cat.contains("Total"), 2)
            .when(cat.contains("Recovered") | cat.contains("Improved") | cat.contains("Regained"), 1)
            .otherwise(0))


def _compared(j: DataFrame, keys) -> DataFrame:
    """11 rows per scenario from the arrays __b (do nothing) and __p (proposed), in display order."""
    rows = F.array(*[F.struct(F.lit(CATEGORY_NAME[c]).alias("category"), F.lit(i).alias("i"))
                     for i, c in enumerate(CATEGORY_COLS)])
    e = j.select(*[q(k) for k in keys], "__b", "__p", F.inline(rows))
    do_nothing = F.element_at("__b", F.col("i") + 1)
    proposed = F.element_at("__p", F.col("i") + 1)
    out = e.select(*[q(k) for k in keys], "category", _order_rank(F.col("category")).alias("sort_order"),
                   do_nothing.alias("do_nothing"), proposed.alias("proposed"), (proposed - do_nothing).alias("difference"))
    return out.orderBy(*[q(k) for k in keys], "sort_order", "category")


def scenario_compare(base_calc: DataFrame, proposed_calc: DataFrame, by=()) -> DataFrame:
    """(scenario, category, sort_order, do_nothing, proposed, difference) - 11 rows per scenario, in display order.

    Both sides have one row per scenario, so the join is one-to-one.
    """
    keys = list(by)
    b = base_calc.select(*[q(k) for k in keys], F.array(*[F.col(c) for c in CATEGORY_COLS]).alias("__b"))
    p = proposed_calc.select(*[q(k) for k in keys], F.array(*[F.col(c) for c in CATEGORY_COLS]).alias("__p"))
    return _compared(b.join(p, keys, "inner") if keys else b.crossJoin(p), keys)  # without keys both are single rows


def scenario_compare_overrides(inputs: DataFrame, overrides: DataFrame, by=()) -> DataFrame:
    """``scenario_compare`` of ``scenario_inputs``' result and the same with overrides: the inputs are read
    once, joined with their overrides and both sides come from one aggregate per scenario."""
    keys = list(by)
    o = overrides.select(*[q(k) for k in keys], q("Assumption"), q("Value").alias("__new"))
    num, ok = parse_value(F.coalesce(F.col("__new"), q("Value")))
    j = inputs.join(o, [*keys, "Assumption"], "left").withColumns({"__num": num, "__ok": ok})
    g = j.groupBy(*[q(k) for k in keys]) if keys else j.groupBy()
    w = g.agg(*_wide_aggs("", "value_num", "parsed_ok"), *_wide_aggs("p_", "__num", "__ok")).select(
        *[q(k) for k in keys], *_wide_columns(""), *_wide_columns("p_"))
    sides = []
    for prefix, name in (("", "__b"), ("p_", "__p")):
        r = calc([F.col(f"{prefix}v{i}") for i in range(len(SCENARIO_LABELS))], F.col(f"{prefix}failed"))
        sides.append(F.array(*[r[c] for c in CATEGORY_COLS]).alias(name))
    return _compared(w.select(*[q(k) for k in keys], *sides), keys)


def scenario_sweep(base_inputs: DataFrame, sweep: DataFrame, key_cols, set_values) -> DataFrame:
    """Evaluate many scenarios: one baseline (global, one row) with numeric overrides per sweep row.

    ``sweep`` holds the scenario keys and one numeric column per label in
    ``set_values`` ({label: column}). The baseline is a global aggregate, so
    the cross join pairs every sweep row with exactly one row.
    """
    w = wide_inputs(base_inputs)
    base_v = [F.col(f"v{i}") for i in range(len(SCENARIO_LABELS))]
    base_res = calc(base_v, F.col("failed"))
    base_net = (base_res["total_positive_impact"] + base_res["total_negative_impact"]).alias("__base_net")
    wb = w.select("*", base_net)
    j = sweep.crossJoin(F.broadcast(wb))
    v, failed = [], F.col("failed")
    for i, label in enumerate(SCENARIO_LABELS):
        if label in set_values:
            v.append(F.when(F.col(f"has{i}"), F.col(set_values[label])).otherwise(F.col(f"v{i}")))
        else:
            v.append(F.col(f"v{i}"))
    res = calc(v, failed)
    net = res["total_positive_impact"] + res["total_negative_impact"]
    return j.select(*[q(k) for k in key_cols], res["total_negative_impact"].alias("total_negative_impact"),
                    res["total_positive_impact"].alias("total_positive_impact"), net.alias("net_impact"),
                    (net - F.col("__base_net")).alias("net_vs_baseline"))


def parse_range(text: Column) -> Column:
    """Sensitivity Range text such as ``±10%`` or ``+/- 15 %`` as a fraction (0.10, 0.15)."""
    return F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") / 100.0


def sensitivity(inputs: DataFrame, by=(), spread: float = 0.10, ranges: DataFrame | None = None) -> DataFrame:
    """Net impact at the low and high end of every present assumption.

    Ends are value * (1 - r) and value * (1 + r), with ``r`` from the
    Sensitivity tab's range of that assumption (``ranges``: Assumption/Scenario
    Input, Sensitivity Range) or ``spread`` when the tab has no row for it. One
    row per (scenario, assumption); both ends are computed in the same row.
    """
    w = wide_inputs(inputs, by)
    idx = F.array(*[F.when(F.col(f"has{i}"), F.lit(i)) for i in range(len(SCENARIO_LABELS))])
    e = w.select("*", F.explode(F.filter(idx, lambda x: x.isNotNull())).alias("__i"))
    labels = F.array(*[F.lit(l) for l in SCENARIO_LABELS])
    e = e.withColumn("assumption", F.element_at(labels, F.col("__i") + 1))
    if ranges is not None:
        r = ranges.select(q("Assumption/Scenario Input").alias("assumption"),
                          parse_range(q("Sensitivity Range")).alias("__r"), F.col(ROW))
        r = r.groupBy("assumption").agg(F.min_by("__r", F.col(ROW)).alias("__r"))  # first row per label
        e = e.join(r, "assumption", "left")  # a few rows per label: AQE broadcasts it
        rate = F.coalesce(F.col("__r"), F.lit(spread))
    else:
        rate = F.lit(spread)
    e = e.withColumn("__lo", F.lit(1.0) - rate).withColumn("__hi", F.lit(1.0) + rate)
    base = F.element_at(F.array(*[F.col(f"v{i}") for i in range(len(SCENARIO_LABELS))]), F.col("__i") + 1)

    def at(f: Column):
        v = [F.when(F.col("__i") == i, F.col(f"v{i}") * f).otherwise(F.col(f"v{i}")) for i in range(len(SCENARIO_LABELS))]
        r_ = calc(v, F.col("failed"))
        return r_["total_positive_impact"] + r_["total_negative_impact"]

    return e.select(*[q(b) for b in by], "assumption",
                    base.alias("base_value"), (base * F.col("__lo")).alias("low_value"),
                    (base * F.col("__hi")).alias("high_value"),
                    at(F.col("__lo")).alias("impact_low"), at(F.col("__hi")).alias("impact_high"))


def scenario_totals(do_nothing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Total impact per scenario tab and net against the do-nothing total."""
    a = impact_frame(do_nothing).select(F.lit("Do Nothing").alias("scenario"), "__annual", FAR)
    b = impact_frame(proposed).select(F.lit("Proposed").alias("scenario"), "__annual", FAR)
    t = aggregate(a.unionByName(b), ("scenario",), [Sum("total_annualized_impact", F.col("__annual"))])
    # a global aggregate over at most two rows: exactly one row, so the cross join adds one column
    base = t.agg(F.max(F.when(F.col("scenario") == "Do Nothing", F.col("total_annualized_impact"))).alias("__base"))
    return t.crossJoin(base).select(
        "scenario", "total_annualized_impact",
        (F.col("total_annualized_impact") - F.coalesce(F.col("__base"), F.lit(0.0))).alias("net_incremental_value"))
