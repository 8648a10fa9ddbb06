"""Keyed row updates (write-back) and their report.

Updates are long rows ``(key, column, value, seq)``. Rules of the reference:
the key column must exist; only the *first* row (sheet order) with the key
changes; unknown columns are skipped; values are written as text; a key that
is not found is rejected. A null value sets nothing. Later updates of the same
(key, column) win (by ``seq``; of equal ``seq`` the greater text).

Plan: the updates are grouped once by key, the table's keys are first reduced to
those that have updates (semi join), the first row of each such key is a
partial aggregate ``min(_row)`` (a hot key collapses map-side), and the result
is settled as files, so that its size is known before the table's rows are touched:
it reaches the table through one equi join on ``_row``, broadcast where it is small.
A shuffle join would write every row of a wide table to reach few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_output_path
from ..sources.tabs import ROW, q

#: Rows of a settled side that every task may hold (some hundred bytes each).
BROADCAST_ROWS = 500_000


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, marked for broadcast where it has few rows."""
    path = new_output_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return F.broadcast(back) if back.count() <= BROADCAST_ROWS else back  # counted from the files' footers


def _valid(df: DataFrame, key: str, updates: DataFrame) -> tuple[DataFrame, list]:
    cols = [c for c in df.columns if c not in (ROW, key) and not c.startswith("__")]
    valid = updates.where(F.col("column").isin(*cols)) if cols else updates.where(F.lit(False))
    return valid, cols


def form_payload(updates: DataFrame, drop_blank: bool) -> DataFrame:
    """M7 (project form) keeps ``''`` as a value to write; M8 (opportunity form) drops it."""
    return updates.where(F.col("value") != "") if drop_blank else updates


def latest_values(valid: DataFrame) -> DataFrame:
    """(key, column, value): the last value set of each cell."""
    text = F.col("value").cast("string")
    return valid.where(F.col("value").isNotNull()).groupBy("key", "column").agg(F.max_by(text, F.struct("seq", text)).alias("value"))


def value_sets(valid: DataFrame) -> DataFrame:
    """(key, __set): the last values of each key's cells by column, at most one entry a column."""
    return latest_values(valid).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__set"))


def apply_updates(df: DataFrame, key: str, updates: DataFrame) -> DataFrame:
    """The tab after applying ``updates``; same columns, same rows."""
    if key not in df.columns:
        return df
    valid, cols = _valid(df, key, updates)
    rows = df.select(q(key).alias("key"), F.col(ROW).alias("__row")).join(updates.select("key").distinct(), "key", "left_semi")
    firsts = rows.groupBy("key").agg(F.min("__row").alias("__first"))
    targets = settled(firsts.join(value_sets(valid), "key").select("__first", "__set"), "updates")
    j = df.join(targets, df[ROW] == targets["__first"], "left")
    return j.select(*[F.coalesce(targets["__set"][c], q(c)).alias(c) if c in cols else df[f"`{c}`"] for c in df.columns])


def update_report(df: DataFrame, key: str, updates: DataFrame) -> DataFrame:
    """One row per update key: ``applied`` / ``key not found`` / ``no valid field`` and the field count."""
    if key not in df.columns:
        return updates.select("key").distinct().select("key", F.lit("key column missing").alias("status"), F.lit(0).cast("bigint").alias("n_fields"))
    _, cols = _valid(df, key, updates)
    grouped = updates.groupBy("key").agg(F.count_distinct(F.when(F.col("column").isin(*cols), F.col("column"))).alias("n"))
    # the table's keys, cut to those asked for before they are made distinct
    found = df.select(q(key).alias("key")).join(updates.select("key").distinct(), "key", "left_semi").distinct().select("key", F.lit(True).alias("found"))
    r = grouped.join(found, "key", "left")
    status = (F.when(F.col("found").isNull(), F.lit("key not found"))
              .when(F.col("n") == 0, F.lit("no valid field")).otherwise(F.lit("applied")))
    return r.select("key", status.alias("status"), F.when(F.col("found").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("n_fields"))
