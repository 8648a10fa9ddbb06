"""Tabs mapped from their sources when they are read, and tabs stored as files.

A query reads a text tab as a lazy frame over its source tables (``mapped``):
column pruning and filters reach the sources' scans, so it works out the cells
it uses and nothing is written or shuffled beforehand. The frame is built once
per session and state of the source files (names, lengths, times).

Typed tabs with many queries, and the tabs of jobs that work on files
(``operators/state.py``), are ``stored``: written once per such state as they
come, with no shuffle, and scanned afterwards with pushdown and pruning.

``FirstRows`` finds the first rows in sheet order by ``_row`` alone and maps only
those. ``ranged`` writes a tab partitioned by ranges of ``_row`` (``__range``,
numbered in sheet order) with the rows of each range counted, for tabs whose
first rows are asked for often: partition pruning opens the first ranges and
nothing else.
"""

from __future__ import annotations

import hashlib
import threading
import time

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import shared_dir, wide_writes
from .files import fingerprint, remove, size
from .tabs import ROW

MAPPING_VERSION = "10"
RANGE = "__range"
#: For wide tabs of which jobs read a few columns: most cells are unlike, and dictionaries of them cost more to build
#: than all else of a write.
PLAIN_CELLS = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": 32 << 20}
#: Ranges of a stored tab: one for this many bytes, within bounds that keep folders few.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 128 << 20, 8, 4096
_PATHS: dict = {}
_FRAMES: dict = {}
_LOCK = threading.Lock()
INGEST_SECONDS: dict = {}


def state_of(spark: SparkSession, sf_dir: str, name: str, sources=()) -> tuple:
    """What tells one state of a tab's source tables in one session from another."""
    folder = sf_dir.rstrip("/")
    return spark.sparkContext.applicationId, folder, name, tuple(fingerprint(spark, f"{folder}/{t}.parquet") for t in sources)


def mapped(spark: SparkSession, sf_dir: str, name: str, build, sources=()) -> DataFrame:
    """``build(spark, sf_dir)``, not run: the same frame in this session until one of the tables ``sources`` below
    ``sf_dir`` changes."""
    k = state_of(spark, sf_dir, name, sources)
    with _LOCK:
        if k not in _FRAMES:
            _FRAMES[k] = build(spark, sf_dir)
        return _FRAMES[k]


def stored(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, sources=(), options=None) -> str:
    """Folder with a parquet copy of ``rows``, written as they come (by the writer's ``options``) on first use in this
    session and again once one of the tables ``sources`` below ``sf_dir`` has changed."""
    k = state_of(spark, sf_dir, name, sources)
    with _LOCK:
        if k not in _PATHS:
            tag = hashlib.sha1(f"{MAPPING_VERSION}|{k[1]}|{k[0]}|{k[3]}".encode()).hexdigest()[:12]
            path = f"{shared_dir(spark).rstrip('/')}/tabs/{tag}/{name}"
            t0 = time.perf_counter()
            # row groups of some megabytes: a file splits over tasks and statistics prune finely
            with wide_writes(spark):
                rows.write.mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": 8 << 20} | (options or {})).parquet(path)
            INGEST_SECONDS[name] = round(time.perf_counter() - t0, 3)
            _PATHS[k] = path
        return _PATHS[k]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The tab stored at ``path``."""
    k = spark.sparkContext.applicationId, path
    if k not in _FRAMES:
        _FRAMES[k] = spark.read.parquet(path)
    return _FRAMES[k]


class FirstRows:
    """Number of rows and first rows, in sheet order, of a tab that is mapped when read. Asking for either runs a
    job over the columns that tell blank rows and ``_row``."""

    def __init__(self, df: DataFrame):
        self.df, self.spark = df, df.sparkSession

    @property
    def total(self) -> int:
        return self.df.count()

    def first(self, n: int) -> DataFrame:
        """Rows that hold the first ``n`` in sheet order, and those level with the last of them."""
        if n < 1:
            return self.df.limit(0)
        rows = self.df.select(ROW).orderBy(ROW).limit(n)
        last = rows.agg(F.max(ROW).alias("last"), F.bool_or(F.col(ROW).isNull()).alias("empty")).first()
        # a bound that is a value reaches the sources' scans; rows without a place in the sheet come first
        kept = F.lit(False) if last["last"] is None else F.col(ROW) <= _literal(last["last"], self.df.schema[ROW].dataType)
        return self.df.where(kept | F.col(ROW).isNull() if last["empty"] else kept)


def _literal(value, kind: DataType) -> Column:
    """A value of ``_row`` as it stands in a frame of that type."""
    if isinstance(kind, StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def ranged(df: DataFrame, path: str) -> None:
    """Write ``df`` to ``path`` partitioned by ranges of ``_row``. It is written as it comes first, so that
    finding the ranges' bounds and sorting rows into them read stored files instead of working it out twice."""
    spark = df.sparkSession
    plain = f"{path}-plain"
    df.write.mode("overwrite").parquet(plain)
    rows = spark.read.parquet(plain)
    if rows.isEmpty():  # no partition to write: one file that holds the schema
        rows.withColumn(RANGE, F.lit(0)).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        n = max(LEAST_RANGES, min(MOST_RANGES, size(spark, plain) // RANGE_BYTES))
        parts = rows.repartitionByRange(n, ROW).withColumn(RANGE, F.spark_partition_id())
        parts.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy(RANGE).parquet(path)
    spark.read.parquet(path).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}-ranges")
    remove(spark, plain)


@dataclass
class Ranges:
    """A stored tab by its ranges: [(range, rows)] in sheet order, at most some thousand."""

    spark: SparkSession
    path: str
    counts: list[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def first(self, n: int) -> DataFrame:
        """Rows that hold the first ``n`` in sheet order: those of the first ranges."""
        upto, seen = -1, 0
        for r, rows in self.counts:
            if seen >= n:
                break
            upto, seen = r, seen + rows
        return self.spark.read.parquet(self.path).where(F.col(RANGE) <= upto).drop(RANGE)


_RANGES: dict = {}


def ranges(spark: SparkSession, path: str) -> Ranges:
    """The ranges of the tab stored at ``path``."""
    if path not in _RANGES:
        rows = spark.read.parquet(f"{path}-ranges").collect()
        _RANGES[path] = sorted((r[RANGE], r["n"]) for r in rows)
    return Ranges(spark, path, _RANGES[path])
