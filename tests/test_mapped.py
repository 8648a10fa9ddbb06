"""Tabs mapped when read: no exchange or write of the tab beforehand; first rows and blank rows as in a stored tab."""

from conftest import tab
from pulseboard.operators import distributions as DI
from pulseboard.operators import report as R
from pulseboard.operators import scores as S
from pulseboard.plans import catalog as cat
from pulseboard.sources import driver, store
from pulseboard.sources.tabs import clean_tab
from pyspark.sql import functions as F


def lines(spark, folder):
    """A small lineitem table with repeated rows, nulls and a row that fills no cell."""
    rows = [(k, k % 3, k % 2, k % 5, float(k), 1.5 * k, "A", "F") for k in range(40)] * 2 + [(None, 1, None, None, None, 2.5, None, None), (None, None, None, 3, None, None, "X", "X")]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    li.withColumn("l_shipdate", F.when(F.col("l_orderkey") > 3, F.lit("1998-01-02").cast("timestamp"))).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(0, "s"), (1, "")], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_the_pipeline_tab_is_not_shuffled_or_stored(spark, tmp_path):
    sf = lines(spark, tmp_path)
    before = dict(store.INGEST_SECONDS)
    df = cat.typed_pipeline(spark, sf)
    plan = df.select("__pscore")._jdf.queryExecution().executedPlan().toString()
    assert store.INGEST_SECONDS == before and "rangepartitioning" not in plan and "hashpartitioning" not in plan
    assert df.count() == 81  # the row without any cell is left out
    assert df.where("Account is null").count() == 41  # '' became null


def test_first_rows_are_those_of_a_whole_sort(spark, tmp_path):
    t = cat.pipeline(spark, lines(spark, tmp_path))
    for cap in (0, 1, 7, 200):
        got = R.context_snapshot([("Pipeline", t, store.FirstRows(t))], caps=(("Pipeline", cap),))
        want = [" | ".join("<NA>" if v is None else v for v in r[:-1]) for r in t.orderBy("_row").limit(cap).collect()]
        rows = [r.text for r in got.orderBy("line_no").collect() if r.line_no > 1 and not r.text.startswith("...")]
        assert sorted(rows) == sorted(want)


def test_blank_rows_go_and_wide_tabs_plan(spark):
    t = tab(spark, "Project Inventory", [{"Project Name": "p"}, {"Project Name": ""}, {}, {"Total Project Score": "1"}])
    assert sorted(r._row for r in clean_tab(t).collect()) == [0, 3]


def test_the_risks_tab_is_not_stored(spark, tmp_path):
    sf = lines(spark, tmp_path)
    before = dict(store.INGEST_SECONDS)
    risks = cat.typed_risks(spark, sf)
    got = {r.severity: (r.risk_count, r.total_impact) for r in DI.risk_by_severity(risks).collect()}
    assert store.INGEST_SECONDS == before
    assert got == {"Medium": (26 * 2, 2 * sum(1.5 * k for k in range(40) if k % 3)), "Unknown": (14 * 2 + 2, 2 * sum(1.5 * k for k in range(0, 40, 3)) + 2.5)}


def orders(spark, folder):
    """A small orders table with a repeated row, a row without key and a customer that stands there twice."""
    rows = [(k, k % 3, "FOP"[k % 3], 100.5 * k, "1-URGENT") for k in range(30)] + [(4, 1, "O", 402.0, "1-URGENT"), (None, None, None, None, None)]
    o = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    o.withColumn("o_orderdate", F.when(F.col("o_orderkey") > 3, F.lit("1998-01-02").cast("timestamp"))).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(0, "c"), (1, ""), (0, "d")], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0,), (1,)], "r_regionkey long").write.parquet(f"{folder}/region.parquet")
    return str(folder)


def test_the_projects_tab_is_not_stored_for_its_scores(spark, tmp_path):
    sf = orders(spark, tmp_path)
    before = dict(store.INGEST_SECONDS)
    bands = DI.project_score_bands(cat.typed_projects(spark, sf)).collect()
    letters = S.letter_bands(cat.typed_projects(spark, sf), cat.typed_pipeline(spark, lines(spark, tmp_path)))
    totals = S.weighted_totals(cat.projects(spark, sf), driver.mapping(spark))
    assert letters.where("tab = 'Project Inventory'").count() == totals.count() == 42  # the blank rows are left out, the repeated ones stay
    assert sum(r.band_count for r in bands if r.score_name == "project_health_score") == 42
    assert store.INGEST_SECONDS == before
