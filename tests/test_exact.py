"""Exact sums against exact fractions, in any order and partitioning."""

import math
import random
from decimal import Decimal, localcontext

from pulseboard.functions import exact as E
from pulseboard.sources.literal import literal_frame
from pyspark.sql import functions as F


def want(values):
    with localcontext() as c:
        c.prec = 1400
        return float(sum((Decimal(repr(v)) for v in values), Decimal(0)))


def frame(spark, groups):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


def sums(df, by=("g",)):
    out = E.aggregate(df, by, [E.Sum("s", F.col("v")), E.Mean("m", F.col("v")), F.count(F.lit(1)).alias("n")]).collect()
    return {(r.g if by else None): (r.s, r.m, r.n) for r in out}


GROUPS = {
    "fine": [4e-11] * 1000,
    "cancel": [1e22, 1.0, -1e22],
    "near cancel": [1e22, -9.999999999999999e21, 1.0],
    "negative": [-1e300, 3.5, -2.25e-12, 7e-320],
    "zero": [1e25, -1e25],
    "small": [0.1] * 10,
    "mixed": [123.45, -0.000000000012345, 1.7e308, -1.7e308, 5e-324],
    "over": [1.7e308, 1.7e308],
    "edge": [1e11, 99999999999.9999, 123456789.00005, 1e14, 99999999999999.99, -1e14, 1e-10, 1.00000000005],
}


def test_sums_are_exact_in_any_order(spark):
    rng = random.Random(7)
    groups = dict(GROUPS)
    for k in range(40):
        pool = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-30, 30) for _ in range(rng.randrange(1, 30))]
        pool = [float(f"{v:.12g}") for v in pool]
        groups[f"random {k}"] = pool + [-v for v in pool[: rng.randrange(len(pool))]] + [0.25]
    df = frame(spark, groups)
    for d in (df.repartition(1), df.repartition(7), df.orderBy(F.rand(3))):
        got = sums(d)
        for g, vs in groups.items():
            total = want(vs)
            assert got[g][0] == total and got[g][2] == len(vs), g
            assert got[g][1] == total / len(vs), g
    assert got["fine"][0] == 4e-8 and got["cancel"][0] == 1.0


def test_one_row_without_groups(spark):
    df = frame(spark, {"a": [1e22, 1.0], "b": [-1e22, 2e-30]})
    assert sums(df, ())[None][0] == 1.0
    assert sums(df.limit(0), ())[None] == (0.0, 0.0, 0)
    assert sums(df.limit(0)) == {}


def test_nulls_and_special_values(spark):
    df = spark.createDataFrame([("n", None), ("n", None), ("i", math.inf), ("i", 1e20), ("x", math.nan), (None, 1e30), (None, 1.0), ("o", None), ("o", 2.5)], "g string, v double")
    got = sums(df)
    assert got["n"] == (0.0, 0.0, 2) and got["i"][0] == math.inf and math.isnan(got["x"][0])
    assert got[None][0] == 1e30 and got["o"] == (2.5, 2.5, 2)


def test_sums_of_one_row(spark):
    rows = [[1e22, 1.0, -1e22], [0.1, 0.2, 0.3], [4e-11, None, 4e-11], [None, None, None], [float("1" * 25), 2.0, 3.0]]
    df = spark.createDataFrame([tuple(r) for r in rows], "a double, b double, c double")
    got = [r.s for r in df.select(E.row_sum(list("abc")).alias("s")).collect()]
    assert got == [want([v for v in r if v is not None]) for r in rows]


def test_groups_named_like_nothing_else(spark):
    df = literal_frame(spark, [("x", 1e15, 1), ("x", 0.5, 2)], [("Client (a.b)", "string"), ("v", "double"), ("_row", "bigint")])
    r = E.aggregate(df, ("Client (a.b)",), [E.Sum("s", F.col("v"))]).first()
    assert r["Client (a.b)"] == "x" and r.s == 1e15 + 0.5


def test_no_cell_ends_or_cuts_a_job(spark):
    import datetime as dt

    from conftest import tab
    from pulseboard.operators import distributions as DI
    from pulseboard.operators import kpis as K
    from pulseboard.operators import scenario as SC
    from pulseboard.operators import scores as S
    from pulseboard.operators import staffing as ST

    long = "1" * 25
    fine, big = "0.00000000004", ["1" + "0" * 22, "1", "-1" + "0" * 22]
    p = tab(spark, "Project Inventory", [{"Project Name": "A", "Client": "c", "Timeline Health": "Yes", "Budget and Scope": "Big", "Revenue": fine} for _ in range(1000)])
    staff = tab(spark, "Team Utilization", [{"Employee Name": f"s{i}", "Project Assignments": "A", "Utilization (%)": u, "Latest Pulse Score": fine} for i, u in enumerate(big)])
    r = ST.staffing_health(p.limit(1), staff, dt.date(2025, 6, 30)).first()
    assert (r["Assigned Team Size"], r["Avg. Team Utilization %"], r["Avg. Team Pulse Score"]) == (3, 1.0 / 3, 1.2e-10 / 3)
    mapping = tab(spark, "MappingTable", [{"Tab": "Project Inventory", "Value": "Yes", "Score": long}, {"Tab": "Project Inventory", "Value": "Big", "Score": "2.0000001"}])
    assert S.project_health_lookup(p, mapping).first().project_health_score == want([float(long), 2.0000001])
    assert S.weighted_totals(p, mapping).first().project_health_score == want([float(long), 2.0000001])
    assert K.kpi_revenue(p).first().total_revenue == 4e-8
    pipe = tab(spark, "Pipeline", [{"Account": "a", "Open Pipeline_Active Work": b, "Percieved Annual AMO": fine} for b in big])
    k = K.kpi_pipeline(pipe).first()
    assert (k.active_pipeline_value, k.total_potential_pipeline_value) == (1.0, 1.2e-10)
    risks = tab(spark, "Project Risks", [{"Severity": "High", "Impact ($)": b} for b in big] + [{"Severity": "High", "Impact ($)": fine}])
    assert K.kpi_risk(risks).first().total_risk_impact == 1.00000000004
    assert {x.severity: x.total_impact for x in DI.risk_by_severity(risks).collect()} == {"High": 1.00000000004}
    assert K.kpi_exec_cost(tab(spark, "Executive Activity", [{"Strategic Cost ($)": b} for b in big])).first().total_strategic_cost == 1.0
    a, b = (tab(spark, n, [{"Annualized Impact ($)": x} for x in big]) for n in ("Do Nothing Scenario", "Proposed Scenario"))
    assert {r.scenario: r.total_annualized_impact for r in SC.scenario_totals(a, b).collect()} == {"Do Nothing": 1.0, "Proposed": 1.0}
    m = spark.createDataFrame([("x", 1e22, 4e-11), ("x", 1.0, 4e-11), ("x", -1e22, 4e-11)], "g string, r double, c double")
    assert S.margin(m, F.col("r"), F.col("c"), ["g"]).first().cost == 1.2e-10


def test_the_scan_for_far_cells_is_pruned(spark):
    import os

    import pytest

    from pulseboard.plans import catalog as cat

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables not present")
    for name in ("kpi_revenue", "kpi_risk", "kpi_exec_cost", "scenario_totals"):
        plan = cat.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(__far,true)" in plan or "IsNotNull(__far)" in plan, name
