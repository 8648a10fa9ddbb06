"""Tabs stored by ranges of rows: the first rows come from the first ranges alone."""

from conftest import tab
from pulseboard.operators import report as R
from pulseboard.sources import store
from pyspark.sql import functions as F


def test_first_rows_open_only_the_first_ranges(spark, tmp_path):
    path = str(tmp_path / "gaps")
    rows = [{"Skill/Role Needed": f"s{i}", "Urgency": None if i % 3 else "now"} for i in range(400)]
    t = tab(spark, "Talent Gaps", rows).withColumn("__typed", F.lit(1.0)).repartition(5)
    store.ranged(t, path)
    ranges = store.ranges(spark, path)
    assert ranges.total == 400 and len(ranges.counts) == store.LEAST_RANGES
    first = ranges.first(10)
    assert first.count() == ranges.counts[0][1] < 200 and {r["_row"] for r in first.collect()} >= set(range(10))
    assert len(first.inputFiles()) >= 1
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__range" in plan
    plain = t.drop("__typed")
    for cap in (0, 1, 50, 400, 1000):
        want = sorted(map(tuple, R.tab_snapshot("Talent Gaps", 3, plain, cap).collect()))
        got = sorted(map(tuple, R.context_snapshot([("x", plain.limit(0))] * 3 + [("Talent Gaps", plain, ranges)], caps=(("Talent Gaps", cap),)).collect()))
        assert got == want
    assert ranges.first(0).count() == 0


def test_empty_tab(spark, tmp_path):
    path = str(tmp_path / "none")
    store.ranged(tab(spark, "Talent Gaps", []), path)
    ranges = store.ranges(spark, path)
    assert ranges.total == 0
    assert R.context_snapshot([("Talent Gaps", tab(spark, "Talent Gaps", []), ranges)]).count() == 0


def test_a_text_of_whole_tabs_is_refused(spark):
    import pytest

    t = tab(spark, "Talent Gaps", [{"Skill/Role Needed": f"s{i}"} for i in range(40)])
    snap = R.context_snapshot([("Talent Gaps", t)], default=None)
    assert R.context_text(snap).first().context_text.count("\n") == 41
    with pytest.raises(Exception, match="more than 20 lines"):
        R.context_text(snap, most=20).collect()
