"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_output_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null doc_id where an order is needed: after every other id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so a lost
    executor costs only a read of these files."""
    spark = df.sparkSession
    path = new_output_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def in_one(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct "row", so that no name of theirs meets one of the operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def id_crc32(c: Column) -> Column:
    """crc32 of the decimal text of an id (null id: crc32 of empty text, 0)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def bounded_sample(keys: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """About ``limit`` distinct keys at most: all of them, or the share with the smallest hashes that makes
    up nine tenths of ``limit``. The same keys at any partitioning, and no task sends its own best."""
    keys = keys.where(F.col(key).isNotNull()).distinct()
    n = keys.count()
    return keys if n <= limit else keys.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 0.9 * limit / n))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def out_batch(**cols: Iterable | pa.Array) -> pa.RecordBatch:
    names = list(cols)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names)


def pieces(batches: Iterator[pa.RecordBatch], limit_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds much more than ``limit_bytes``: bounds a worker's memory."""
    for b in batches:
        n = max(1, -(-b.nbytes // limit_bytes))
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
