"""Tabs kept as files: what reads them twice; settings of wide writes."""

from pulseboard.operators import staffing as ST
from pulseboard.plans import catalog as cat
from pulseboard.session import wide_writes
from pulseboard.sources import driver
from test_mapped import lines, orders

KEY = "spark.sql.codegen.hugeMethodLimit"


def test_assignments_are_worked_out_once_for_both_sums(spark, tmp_path):
    orders(spark, tmp_path)
    sf = lines(spark, tmp_path)
    plan = ST.teams(cat.filed_staff(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "lineitem" not in plan
    got = {r.project: r.team_size for r in ST.teams(cat.filed_staff(spark, sf)).collect()}
    assert got == {f"Project {k}": 1 for k in range(40)}


def test_the_scenario_comparison_is_worked_out_once(spark, tmp_path):
    sf = orders(spark, tmp_path)
    df = cat.scenario_comparison(spark, sf)
    assert "orders" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.orderBy("_row").collect() == driver.scenario_comparison(spark, sf).orderBy("_row").collect()


def test_wide_writes_leave_the_session_as_it_was(spark):
    old = spark.conf.get(KEY, None)
    try:
        for mine, within in (("65535", "8000"), ("5000", "5000")):
            spark.conf.set(KEY, mine)
            with wide_writes(spark):
                assert spark.conf.get(KEY) == within
            assert spark.conf.get(KEY) == mine
    finally:
        spark.conf.set(KEY, old) if old else spark.conf.unset(KEY)
