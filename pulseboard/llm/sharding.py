"""Sharding by extendible hashing (DataFrame functions only).

A row's hash has 60 bits. The directory is indexed by a prefix of them: a bucket whose bytes exceed the
limit, and no other, is split on one more bit, until every bucket fits. Buckets are resolved in strides
of some bits: one aggregate gives the bytes below each prefix of the stride; a prefix that fits under one
that doesn't is a bucket, and every directory entry below it points there. Rows of entries that need
more bits go on to the next stride.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import in_one, stored

HASH_BITS = 60
FIRST_STRIDE, STRIDE = 15, 6  # directory bits resolved by one aggregate, and what it multiplies a bucket by at most


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, h): bytes of the text in UTF-8 and the first 60 bits of the id's MD5."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
                       F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("h"))


def prefix(depth) -> str:
    return f"shiftright(h, {HASH_BITS} - {depth})"


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (doc_id, n_bytes, h) with the bucket of each: depth (prefix bits) and prefix. A bucket that no
    further bit can split (all its rows share the 60 bits) keeps depth 60."""
    done, left, base = [], rows.withColumn("at", F.lit(0).cast("bigint")), 0
    while base < HASH_BITS:
        top = min(base + (STRIDE if base else FIRST_STRIDE), HASH_BITS)
        cells = left.groupBy(F.expr(prefix(top)).alias("cell")).agg(F.sum("n_bytes").alias("b"))
        paths = cells.select("b", "cell", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        sums = stored(paths.groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix")).agg(F.sum("b").alias("bytes")), "prefixes")
        above = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("bytes").alias("up_bytes"))
        split = sums.withColumn("up", F.expr("shiftright(prefix, 1)")).join(above, ["depth", "up"], "left").where(F.col("up_bytes").isNull() | (F.col("up_bytes") > limit))
        fits = (F.col("bytes") <= limit) | (F.col("depth") == HASH_BITS)
        # a bucket's entries; a prefix of full depth that is still too large is an entry without bucket
        buckets = split.where(fits | (F.col("depth") == top)).select(F.when(fits, F.col("depth")).alias("leaf"), F.expr(
            f"sequence(shiftleft(prefix, {top} - depth), shiftleft(prefix + 1, {top} - depth) - 1)").alias("cells"))
        entries = stored(buckets.select("leaf", F.explode("cells").alias("cell")), "entries")
        met = stored(left.withColumn("cell", F.expr(prefix(top))).join(entries, "cell"), "sharded")
        done.append(met.where("leaf is not null").select("doc_id", "n_bytes", "h", F.col("leaf").alias("depth"), F.expr(prefix("leaf")).alias("prefix")))
        left, base = met.where("leaf is null").select("doc_id", "n_bytes", "h"), top
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def shards(docs: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8 bytes of the text), shard (the bits of its
    bucket's prefix; empty when everything fits one shard), part (0, or the number of the part of a shard
    that no hash bit can split), shard_bytes and shard_docs (of that shard and part).

    Every shard holds at most ``limit`` bytes, except one whose only row is larger by itself (its own
    part). Rows of one doc_id share the hash: where they alone exceed the limit, their shard is cut into
    parts. Null text: 0 bytes; null doc_id: hashed as empty text. An empty table gives an empty result."""
    placed = directory(hashed(docs), limit)
    placed = placed.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')")))
    # parts of unsplittable shards: running bytes within salted lanes, each lane with its share of parts
    totals = placed.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("total"), F.count("*").alias("docs"))
    fit = totals.where(F.col("total") <= limit).select("shard", F.col("total").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    whole = placed.join(fit, "shard").select("doc_id", "n_bytes", "shard", F.lit(0).cast("bigint").alias("part"), "shard_bytes", "shard_docs")
    return whole.unionByName(overflow(placed.join(fit, "shard", "left_anti"), limit))


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Parts of at most ``limit`` bytes of shards whose rows share all hash bits. The rows of one shard are
    alike in key, so they are numbered by size class: rows of at most limit / 2^k bytes, 2^k to a part."""
    k = F.when(F.col("n_bytes") <= 0, F.lit(20)).otherwise(F.greatest(F.lit(0), F.least(F.lit(20), F.floor(F.log2(F.lit(float(limit)) / F.col("n_bytes"))))))
    numbered = stored(rows.select("doc_id", "n_bytes", "shard", k.cast("int").alias("k"), F.monotonically_increasing_id().alias("id")), "overflow")
    # a two-step running number: within a lane of ids, then over the lanes' counts
    lane = numbered.withColumn("lane", F.shiftright("id", 12))
    before = lane.groupBy("shard", "k", "lane").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.partitionBy("shard", "k").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)))
    lane = lane.join(before.select("shard", "k", "lane", "before"), ["shard", "k", "lane"])
    number = F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy("shard", "k", "lane").orderBy("id")) - 1
    parts = lane.withColumn("part", F.floor(number / F.pow(F.lit(2.0), F.col("k"))).cast("bigint") * 21 + F.col("k"))
    sums = parts.groupBy("shard", "part").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return parts.join(sums, ["shard", "part"]).select("doc_id", "n_bytes", "shard", "part", "shard_bytes", "shard_docs")


def numbered_alike(rows: DataFrame) -> DataFrame:
    """Rows (key, n_bytes, ...) with a running number among those of equal key and bytes: within a lane of ids,
    then over the lanes' counts, so no key is numbered in one task."""
    by = ["key", "n_bytes", "lane"]
    lane = stored(rows.withColumn("id", F.monotonically_increasing_id()), "alike").withColumn("lane", F.shiftright("id", 12))
    before = lane.groupBy(*by).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("key", "n_bytes").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("before") + F.row_number().over(W.partitionBy(*by).orderBy("id"))
    return lane.join(before.drop("n"), by).withColumn("number", number).drop("lane", "before", "id")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents below ``path``, one folder per shard and part (placed: the result of ``shards``).
    Every row goes to one part. Rows of one doc_id in several parts are matched to their places by bytes and
    running number: places of equal id and bytes may be exchanged."""
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("key")  # null: ''
    places = stored(placed.select(key, "n_bytes", "shard", "part"), "places")
    apart = stored(places.groupBy("key").agg(F.min_by("shard", "part").alias("shard"), F.min("part").alias("part"), F.max("part").alias("last")), "parts_of_ids")
    several = apart.where("last > part").select("key")
    rows = docs.select(key, F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"), in_one(docs))
    one = rows.join(apart.where("last = part").drop("last"), "key")
    spread = numbered_alike(rows.join(several, "key", "left_semi")).join(numbered_alike(places.join(several, "key", "left_semi")), ["key", "n_bytes", "number"])
    one.select("row.*", "shard", "part").unionByName(spread.select("row.*", "shard", "part")).repartition("shard", "part") \
        .write.partitionBy("shard", "part").parquet(path)


ORACLE = """
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), p AS (
  SELECT doc_id, n_bytes, h, k AS depth, h >> (60 - k) AS prefix FROM d, range(0, 40) r(k)
), t AS (
  SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM p GROUP BY depth, prefix HAVING sum(n_bytes) <= {limit}
), s AS (
  SELECT p.doc_id, p.n_bytes, p.h, min(p.depth) AS depth FROM p JOIN t ON p.depth = t.depth AND p.prefix = t.prefix GROUP BY ALL
)
SELECT s.doc_id, s.n_bytes, CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.h >> (60 - s.depth)), CAST(s.depth AS INTEGER), '0') END AS shard,
       CAST(0 AS BIGINT) AS part, CAST(t.b AS BIGINT) AS shard_bytes, t.n AS shard_docs
FROM s JOIN t ON t.depth = s.depth AND t.prefix = s.h >> (60 - s.depth)
"""
