"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

Documents are taken in batches of ascending doc_id. The line hashes seen so far live in runs: written
tables, hash-bucketed and sorted by hash, in levels. Each batch is merge-anti-joined with the runs; the
hashes it adds become a new run, and when a level holds ``fanout`` runs they are compacted to one run of
the next level. Because batches come in order of doc_id, a hash found in a run belongs to a smaller
doc_id, and of a new hash the smallest doc_id of the batch is the owner.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_output_path
from .common import NO_ID, ascii_lower, in_one, stored

SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """The levelled runs: ``add`` a batch of new (h1, h2), ``seen`` marks which of a batch's hashes are there."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [], []

    def _write(self, hashes: DataFrame) -> str:
        """One run: bucketed and sorted, so that a join with it shuffles only the other side."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        (hashes.select(*HASH).repartition(n, *HASH).write.bucketBy(n, *HASH).sortBy(*HASH)
         .option("path", new_output_path(self.spark, name)).saveAsTable(name))
        self.names.append(name)
        return name

    def add(self, hashes: DataFrame) -> None:
        run, level = self._write(hashes), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:  # runs of one level share no hash
                merged = merged.unionByName(self.spark.table(other))
            run, self.levels[level], level = self._write(merged), [], level + 1

    def unseen(self, hashes: DataFrame) -> DataFrame:
        for level in self.levels:
            for run in level:
                hashes = hashes.join(self.spark.table(run), HASH, "left_anti")
        return hashes

    def close(self) -> None:
        """Forget the run tables (their files stay in the shared folder)."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, did, th, lines): the columns of ``docs``, the order of the document (null doc_id last), a hash that
    tells apart different texts under one doc_id, and the lines (null text: one empty line)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(in_one(docs), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))


def dropped_lines(docs: DataFrame, min_length: int, batches: int, fanout: int) -> DataFrame:
    """(did, th, drop): the places, in order, of the lines that each document loses."""
    spark = docs.sparkSession
    at = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), at, 10000).alias("c")).first()["c"] if at else None
    batch = F.lit(0)
    for c in sorted(set(cuts or [])):
        batch = batch + (F.col("did") > F.lit(c)).cast("int")
    lines = keyed(docs.select("doc_id", "text")).select("did", "th", batch.alias("batch"), F.posexplode("lines").alias("at", "line")) \
        .withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_length) \
        .select("did", "th", "batch", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
    lines = stored(lines, "line_hashes", "batch")
    runs, drops = LineRuns(spark, fanout), []
    for k in range(len(set(cuts or [])) + 1):
        mine = lines.where(F.col("batch") == k)
        owners = stored(mine.groupBy(*HASH).agg(F.min("did").alias("owner"), F.max("did").alias("last")), "line_owners")
        fresh = stored(runs.unseen(owners).withColumn("new", F.lit(True)), "line_fresh")
        # hashes that cost lines here: seen in an earlier batch (all lines go), or held by two documents of this one
        old = owners.join(fresh.select(*HASH), HASH, "left_anti").select(*HASH, F.lit(None).cast("bigint").alias("owner"))
        shared = fresh.where("owner != last").select(*HASH, "owner")
        gone = mine.join(old.unionByName(shared), HASH).where(F.col("owner").isNull() | (F.col("did") != F.col("owner")))
        drops.append(gone.select("did", "th", "at").distinct())
        if k < len(set(cuts or [])):
            runs.add(fresh)
    out = drops[0]
    for d in drops[1:]:
        out = out.unionByName(d)
    # written before the run tables are forgotten
    out = stored(out.groupBy("did", "th").agg(F.array_sort(F.collect_list("at")).alias("drop")), "line_drops")
    runs.close()
    return out


def dedup_lines(docs: DataFrame, min_length: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(row, kept, n_lines, n_dropped): the columns of ``docs``, the text left, its lines before (long), those gone.

    A line's key is the line without white space at both ends, A-Z lower-cased. Lines whose key has at
    least ``min_length`` code points and stands in two or more documents go, except in the smallest
    doc_id that holds it (all its lines there stay). Null or empty text: one empty line, kept. A null
    doc_id comes after every other. Rows that repeat a doc_id count as one document and each keeps the
    owner's lines. An empty table gives an empty result. Keys are compared by 128-bit hashes."""
    drops = dropped_lines(docs, min_length, batches, fanout)
    found = keyed(docs).join(drops.hint("merge"), ["did", "th"], "left")  # grows with the documents: one way at every size
    # the stretches between dropped places, each cut out once: linear in the lines
    found = found.withColumn("edges", F.concat(F.array(F.lit(-1)), F.coalesce("drop", F.array().cast("array<int>")), F.array(F.size("lines"))))
    kept = F.expr("if(size(edges) = 2, lines, flatten(transform(sequence(1, size(edges) - 1), "
                  "i -> slice(lines, edges[i - 1] + 2, edges[i] - edges[i - 1] - 1))))")
    return found.select("row", F.array_join(kept, "\n").alias("kept"), F.size("lines").cast("bigint").alias("n_lines"), (F.size("edges") - 2).cast("bigint").alias("n_dropped"))


def line_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with only the lines kept in ``text`` (and ``n_chars`` counted anew where there is one).
    A null text stays null."""
    there = F.col("row.text").isNotNull()
    new = {"text": F.when(there, F.col("kept")).alias("text"), "n_chars": F.when(there, F.char_length("kept").cast(dict(docs.dtypes).get("n_chars", "bigint"))).alias("n_chars")}
    return dedup_lines(docs, **options).select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


ORACLE = """
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), o AS (
  SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, l.pos, l.line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM l LEFT JOIN o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
