"""Tabs stored by key: lookups without a shuffle of the tab, and write-back that commits.

``store_first_rows`` keeps the first row of every key apart, in a table bucketed and sorted by key, and the
whole tab beside it, each row marked. Form defaults are a scan of the first rows; updates, which touch only first rows,
join them bucket by bucket, and the other rows are appended as they are: neither plan has an exchange of the tab. A key
that holds a third of all rows is one row there, so no bucket is large.

``store_partitioned`` keeps a tab in partitions by hash of the key. ``commit_updates`` works out the new rows
of the partitions that hold touched keys, writes them aside, and then replaces those partitions by Spark's
dynamic partition overwrite; the files of all other partitions stay. What was written aside is the commit's
record: a writer that died leaves either no complete record (the tab is as it was) or one that the next commit
writes again before its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists, remove
from ..sources.tabs import ROW, q
from .updates import _valid, apply_updates, settled, value_sets

FIRST, PART = "__first", "__part"


# -- first rows bucketed by key ---------------------------------------------------------------------------

def store_first_rows(df: DataFrame, key: str, name: str, path: str, buckets: int = 64) -> None:
    """Store ``df`` as the tables ``{name}_rows`` (every row, marked where it is the first of its key in sheet order)
    and ``{name}_first`` (the first rows, bucketed by key) below ``path``. Rows without a key are no first rows.

    ``df`` is worked out in full once. The first rows' places are settled before: where they are few, no row of the
    tab is shuffled to be marked."""
    firsts = settled(df.where(q(key).isNotNull()).groupBy(q(key).alias("__key")).agg(F.min(ROW).alias("__row")), "first_places")
    # the join is on key and row, so that a hot key's rows spread over the tasks
    marked = df.join(firsts, (q(key) == F.col("__key")) & (F.col(ROW) == F.col("__row")), "left").withColumn(FIRST, F.col("__key").isNotNull()).drop("__key", "__row")
    marked.write.mode("overwrite").option("path", f"{path}/rows").saveAsTable(f"{name}_rows")
    first = df.sparkSession.table(f"{name}_rows").where(FIRST).drop(FIRST)
    first.repartition(buckets, q(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/first").saveAsTable(f"{name}_first")


def first_rows(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(f"{name}_first")


def other_rows(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(f"{name}_rows").where(~F.col(FIRST)).drop(FIRST)


def update_stored(spark: SparkSession, name: str, key: str, updates: DataFrame) -> DataFrame:
    """``apply_updates`` of the tab stored under ``name``: only the updates are shuffled, to the tab's buckets."""
    first = first_rows(spark, name)
    valid, cols = _valid(first, key, updates)
    joined = first.join(value_sets(valid), q(key) == F.col("key"), "left")
    out = [F.coalesce(F.col("__set")[c], q(c)).alias(c) if c in cols else q(c) for c in first.columns]
    return joined.select(*out).unionByName(other_rows(spark, name))


# -- partitions by key hash -------------------------------------------------------------------------------

def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def store_partitioned(df: DataFrame, key: str, path: str, parts: int = 64) -> None:
    """Store ``df`` in ``parts`` partitions by hash of the key."""
    df.withColumn(PART, _part(f"`{key}`", parts)).write.mode("overwrite").partitionBy(PART).parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def _replace(spark: SparkSession, path: str, record: str) -> None:
    """Second half of a commit; harmless to repeat."""
    rows = spark.read.parquet(record)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    remove(spark, record)


def commit_updates(spark: SparkSession, path: str, key: str, updates: DataFrame, parts: int = 64) -> list[int]:
    """Apply ``updates`` (as ``apply_updates`` does) to the tab stored at ``path`` with ``parts`` partitions;
    returns the numbers of the partitions replaced. Updates without a value set, of unknown columns or of absent
    keys touch no partition."""
    record = f"{path.rstrip('/')}-commit"
    if exists(spark, f"{record}/_SUCCESS"):
        _replace(spark, path, record)
    tab = spark.read.parquet(path)
    valid, _ = _valid(tab.drop(PART), key, updates)
    asked = valid.where(F.col("value").isNotNull()).select(F.col("key").cast(tab.schema[key].dataType).alias("__k")).distinct()
    # only the partitions the keys hash to are looked through for them; at most ``parts`` numbers come here
    may = [r[PART] for r in asked.select(_part("__k", parts).alias(PART)).distinct().collect()]
    held = tab.where(F.col(PART).isin(may)).select(q(key).alias("__k"), PART).join(asked, "__k", "left_semi")
    touched = sorted(r[PART] for r in held.select(PART).distinct().collect())
    if not touched:
        return []
    mine = tab.where(F.col(PART).isin(touched))  # partition pruning: the others are not opened
    new = apply_updates(mine.drop(PART), key, updates).withColumn(PART, _part(f"`{key}`", parts))
    new.write.mode("overwrite").partitionBy(PART).parquet(record)
    _replace(spark, path, record)
    return touched
