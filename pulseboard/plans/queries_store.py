"""Queries over stored tabs: refresh from file states, write-back that commits, key access, with oracle SQL."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..operators import keyed as KY
from ..operators import lists as L
from ..operators import state as ST
from ..operators import updates as U
from ..session import new_output_path, wide_writes
from ..sources import driver, store
from ..sources.files import remove
from ..sources.tabs import ROW, q
from . import catalog as cat
from .catalog import AS_OF, ORACLE, query
from .queries_core import KPI_ALL_SQL

_KEYED: dict = {}
_STATE: dict = {}
_LOCK = threading.Lock()


@query("kpi_refresh", KPI_ALL_SQL)
def q_kpi_refresh(spark, sf):
    """The KPI bundle from file states, after files of Project Inventory were added, changed and removed."""
    folder = new_output_path(spark, "projects_files")
    app = spark.sparkContext.applicationId
    state = _STATE.setdefault(app, new_output_path(spark, "kpi_state"))  # the other tabs' files keep theirs from call to call
    now = cat.projects(spark, sf).withColumn("part", F.pmod(F.xxhash64(ROW), F.lit(8)).cast("int"))
    other = now.where("part = 0").select(*[(-2_000_000_000_000 - F.col(ROW)).alias(ROW) if c == ROW else F.lit(8).alias(c) if c == "part" else q(c) for c in now.columns])
    before = now.where("part <> 3").withColumn("Revenue", F.when(F.col("part") == 5, F.lit("$1")).otherwise(q("Revenue"))).unionByName(other)
    with wide_writes(spark):
        before.write.options(**store.PLAIN_CELLS).partitionBy("part").parquet(folder)
    folders = {"projects": folder}
    for tab, load in (("pipeline", cat.typed_pipeline), ("risks", cat.typed_risks), ("staff", cat.typed_staff), ("exec_activity", cat.typed_activity)):
        folders[tab] = cat.files(spark, sf, tab, load(spark, sf), store.PLAIN_CELLS)
    ST.refresh_bundle(spark, folders, state, AS_OF)
    with wide_writes(spark):
        now.where("part in (3, 5)").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**store.PLAIN_CELLS).partitionBy("part").parquet(folder)
    remove(spark, f"{folder}/part=8")
    ST.refresh_bundle(spark, folders, state, AS_OF)
    return ST.bundle_from_state(spark, folders, state, AS_OF)


@query("write_back", ORACLE["row_updates"])
def q_write_back(spark, sf):
    """Project Inventory stored by key hash, the project form's updates committed, and the tab read back."""
    from .queries_report import PROJECT_OUT

    path = new_output_path(spark, "projects_by_key")
    KY.store_partitioned(cat.stored_projects(spark, sf), "Project Name", path, 32)
    KY.commit_updates(spark, path, "Project Name", U.form_payload(driver.project_updates(spark, sf, AS_OF), drop_blank=False), 32)
    return KY.read_partitioned(spark, path).select(ROW, *[q(c) for c in PROJECT_OUT])


def _by_key(spark, sf, name, key, load):
    """Name of the tables that hold a tab's first rows by key and the rest, stored once per state of its sources."""
    with _LOCK:
        source = store.state_of(spark, sf, name, driver.SOURCES[name])
        if source not in _KEYED:
            path = new_output_path(spark, f"{name}_by_key")
            table = path.rsplit("/", 1)[1].replace("-", "_")
            KY.store_first_rows(load(spark, sf), key, table, path, 16)
            _KEYED[source] = table
        return _KEYED[source]


@query("keyed_lookup", ORACLE["entity_lookup"])
def q_keyed_lookup(spark, sf):
    """Form defaults of every opportunity from the stored first rows."""
    return L.entity_defaults(KY.first_rows(spark, _by_key(spark, sf, "pipeline", "Account", cat.pipeline)))


@query("keyed_updates", ORACLE["row_updates"])
def q_keyed_updates(spark, sf):
    """The project form's updates joined with the stored first rows, bucket by bucket."""
    from .queries_report import PROJECT_OUT

    table = _by_key(spark, sf, "projects", "Project Name", cat.stored_projects)
    upd = U.form_payload(driver.project_updates(spark, sf, AS_OF), drop_blank=False)
    return KY.update_stored(spark, table, "Project Name", upd).select(ROW, *[q(c) for c in PROJECT_OUT])
