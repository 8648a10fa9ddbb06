"""Input files: which files a folder holds, and what tells one version of a file from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """A file's path in one spelling: percent signs decoded (``_metadata`` encodes them), one slash after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _id(path: Column, size: Column, changed: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, size.cast("string"), F.unix_millis(changed).cast("string")), 256)


def file_id(path: Column, size: Column, changed: Column) -> Column:
    """Identity of a file version from the ``_metadata`` columns of a scan."""
    return _id(plain_path(_decoded(path)), size, changed)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_id) of the data files below ``folder``; the files' contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("path", _id(plain_path(F.col("path")), F.col("length"), F.col("modificationTime")).alias("file_id"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the file or folder at ``path`` in a few characters; '' where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return ""
    status = fs.getFileStatus(hadoop)
    if status.isFile():
        return f"{status.getLen()}-{status.getModificationTime()}"
    r = listing(spark, path).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_id")).alias("x")).first()
    return f"{r['n']}-{r['x']}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of this library's own making."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
