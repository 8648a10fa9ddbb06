"""Tabs stored by key: lookups and updates without an exchange of the tab; write-back that commits."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import tab
from pulseboard.operators import keyed as KY
from pulseboard.operators import lists as L
from pulseboard.operators import updates as U


def rows(n):
    out = [{"Project Name": f"p{i % 17}" if i % 3 else "hot", "Key Issues": f"k{i}", "Status (R/Y/G)": "RYG"[i % 3]} for i in range(n)]
    return out + [{"Project Name": None, "Key Issues": "no name"}]


UPDATES = [("p1", "Key Issues", "new", 1), ("p1", "Key Issues", "newer", 2), ("hot", "Status (R/Y/G)", "G", 1), ("hot", "Key Issues", None, 9), ("p2", "Nothing", "x", 1),
           ("p3", "Key Issues", "", 1), ("absent", "Key Issues", "x", 1), ("p4", "Key Issues", "b", 5), ("p4", "Key Issues", "a", 5)]


@pytest.fixture
def updates(spark):
    return spark.createDataFrame(UPDATES, "key string, column string, value string, seq bigint")


def content(df):
    return sorted(map(str, df.select("_row", "`Project Name`", "`Key Issues`", "`Status (R/Y/G)`").collect()))


def test_null_sets_nothing_and_equal_seq_has_one_winner(spark, updates):
    t = tab(spark, "Project Inventory", rows(60))
    got = {r["_row"]: r for r in U.apply_updates(t.repartition(5), "Project Name", updates).collect()}
    assert got[0]["Key Issues"] == "k0" and got[0]["Status (R/Y/G)"] == "G"
    first = {r["Project Name"]: r for r in sorted(got.values(), key=lambda r: -r["_row"])}
    assert first["p1"]["Key Issues"] == "newer" and first["p3"]["Key Issues"] == "" and first["p4"]["Key Issues"] == "b"


def test_first_rows_by_key(spark, updates, tmp_path):
    t = tab(spark, "Project Inventory", rows(200)).repartition(7)
    KY.store_first_rows(t, "Project Name", "t_first_rows", str(tmp_path / "t"), 8)
    assert KY.first_rows(spark, "t_first_rows").count() == 18
    assert content(KY.update_stored(spark, "t_first_rows", "Project Name", updates)) == content(U.apply_updates(t, "Project Name", updates))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more updates than are broadcast
    try:
        plan = KY.update_stored(spark, "t_first_rows", "Project Name", updates)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    # the tab's buckets are joined as they lie: only the updates are shuffled
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "hashpartitioning(Project Name" not in plan
    assert "Exchange" not in L.entity_defaults(KY.first_rows(spark, "t_first_rows"), "Project Name")._jdf.queryExecution().executedPlan().toString()


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_commit_replaces_only_touched_partitions(spark, updates, tmp_path):
    path = str(tmp_path / "tab")
    t = tab(spark, "Project Inventory", rows(200)).repartition(3)
    KY.store_partitioned(t, "Project Name", path, 16)
    before = files(path)
    touched = KY.commit_updates(spark, path, "Project Name", updates, 16)
    after = files(path)
    assert 1 <= len(touched) <= 4
    for p, m in before.items():
        part = int(p.split("__part=")[1].split("/")[0])
        assert (after.get(p) == m) == (part not in touched)
    assert content(KY.read_partitioned(spark, path)) == content(U.apply_updates(t, "Project Name", updates))
    # the same updates again give the same tab; updates that touch nothing replace nothing
    KY.commit_updates(spark, path, "Project Name", updates, 16)
    assert content(KY.read_partitioned(spark, path)) == content(U.apply_updates(t, "Project Name", updates))
    now = files(path)
    assert KY.commit_updates(spark, path, "Project Name", updates.where("key = 'absent' or column = 'Nothing' or value is null"), 16) == [] and files(path) == now


def test_a_writer_lost_between_record_and_tab(spark, updates, tmp_path, monkeypatch):
    path = str(tmp_path / "tab")
    t = tab(spark, "Project Inventory", rows(90))
    KY.store_partitioned(t, "Project Name", path, 8)

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KY, "_replace", die)
    with pytest.raises(RuntimeError, match="lost"):
        KY.commit_updates(spark, path, "Project Name", updates, 8)
    assert content(KY.read_partitioned(spark, path)) == content(t)  # the record alone changes nothing
    monkeypatch.undo()
    gone = glob.glob(f"{path}-commit/__part=*")[0].rsplit("/", 1)[1]
    shutil.rmtree(f"{path}/{gone}")  # the writer died after it had deleted an old partition
    assert KY.commit_updates(spark, path, "Project Name", updates.limit(0), 8) == []
    assert content(KY.read_partitioned(spark, path)) == content(U.apply_updates(t, "Project Name", updates))
    # a record that was never finished is not written
    KY.store_partitioned(t, "Project Name", path, 8)
    os.makedirs(f"{path}-commit/__part=0")
    KY.commit_updates(spark, path, "Project Name", updates.where("key = 'p1'"), 8)
    assert content(KY.read_partitioned(spark, path)) == content(U.apply_updates(t, "Project Name", updates.where("key = 'p1'")))


def test_a_changed_input_changes_the_result_within_a_session(spark, tmp_path):
    from pulseboard.plans import catalog as cat

    def write(n):
        spark.range(1, n + 1, numPartitions=1).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment")).toPandas() \
            .to_parquet(str(tmp_path / "customer.parquet"))

    write(5)
    assert cat.operational_gaps(spark, str(tmp_path)).count() == 5
    write(9)
    assert cat.operational_gaps(spark, str(tmp_path)).count() == 9


def hash_exchanges(plan):
    """The shuffles by hash of a plan."""
    return [line for line in plan.split("\n") if "Exchange" in line and "hashpartitioning" in line]


def test_few_updates_reach_the_tab_without_a_shuffle_of_its_rows(spark, updates):
    t = tab(spark, "Project Inventory", rows(300)).repartition(5)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a tab whose size the planner only guesses
    try:
        out = U.apply_updates(t, "Project Name", updates)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and not hash_exchanges(plan)
        got = content(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert got == content(U.apply_updates(t, "Project Name", updates)) and len(got) == 301


def test_first_rows_of_a_tab_are_marked_without_a_shuffle_and_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = tab(spark, "Project Inventory", rows(120) + [{"Project Name": "p1", "Key Issues": "again"}]).repartition(3)
    t = t.mapInArrow(count, t.schema)
    KY.store_first_rows(t, "Project Name", "t_one_pass", str(tmp_path / "t"), 4)
    assert seen.value == 2 * 122  # once for the places of the first rows, once in full
    assert content(KY.first_rows(spark, "t_one_pass").unionByName(KY.other_rows(spark, "t_one_pass"))) == content(t)
    assert KY.first_rows(spark, "t_one_pass").count() == 18


def test_a_large_side_is_joined_by_shuffle_with_the_same_rows(spark, updates, tmp_path, monkeypatch):
    t = tab(spark, "Project Inventory", rows(200)).repartition(4)
    want = content(U.apply_updates(t, "Project Name", updates))
    monkeypatch.setattr(U, "BROADCAST_ROWS", -1)
    assert content(U.apply_updates(t, "Project Name", updates)) == want
    KY.store_first_rows(t, "Project Name", "t_large", str(tmp_path / "t"), 4)
    assert content(KY.update_stored(spark, "t_large", "Project Name", updates)) == want
