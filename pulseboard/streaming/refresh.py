"""Periodic KPI refresh over arriving tab snapshots (Structured Streaming).

The dashboard reloads its workbook every 300 s and recomputes the bundle.
Here a snapshot of Project Inventory is a folder ``snapshot_id=<id>`` of
parquet files below one input folder. Each micro-batch only tells *which*
snapshots changed; the bundle of those snapshots is recomputed from all of
their files (so a snapshot whose files arrive in several batches ends
complete; the semi join on the partition column reads only their folders) and
written with dynamic partition overwrite per snapshot id, so a replayed batch
after a failure rewrites the same partitions (idempotent). State lives in the
checkpoint folder; nothing is kept on the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField

from ..operators import kpis as K
from ..sources.tabs import clean_tab, tab_schema
from ..targets import DEFAULT_TARGETS, Targets

SNAPSHOT = "snapshot_id"
REFRESH_SECONDS = 300


def snapshot_schema():
    s = tab_schema("Project Inventory")
    return s.add(StructField(SNAPSHOT, StringType(), False))


def snapshot_kpis(projects: DataFrame, as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> DataFrame:
    """Project-tab KPIs per snapshot id (one scan, grouped by snapshot)."""
    pf = K.project_frame(clean_tab(projects, "Project Inventory"))
    fams = [K.f_status(pf, t), K.f_revenue(pf, t), K.f_project_scores(pf), K.f_project_extremes(pf),
            K.f_nps(pf, t), K.f_next_deal(pf, as_of, t), K.f_checkins(pf, as_of, t)]
    return K.run(pf, fams, by=(SNAPSHOT,))


def start_refresh(spark: SparkSession, snapshots_dir: str, out_dir: str, checkpoint_dir: str,
                  as_of: dt.date | Callable[[], dt.date] = dt.date.today, t: Targets = DEFAULT_TARGETS,
                  available_now: bool = False, every_seconds: int = REFRESH_SECONDS) -> StreamingQuery:
    """Run the refresh. ``as_of``: a date, or a function that each batch asks for its own (a query that runs
    for days must not judge by the day it began)."""
    schema = snapshot_schema()

    def refresh(batch: DataFrame, epoch_id: int) -> None:
        changed = batch.select(SNAPSHOT).distinct()
        full = spark.read.schema(schema).parquet(snapshots_dir).join(changed, SNAPSHOT, "left_semi")
        day = as_of() if callable(as_of) else as_of
        (snapshot_kpis(full, day, t).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(SNAPSHOT).parquet(out_dir))

    w = (spark.readStream.schema(schema).parquet(snapshots_dir)
         .writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{every_seconds} seconds")
    return w.start()
