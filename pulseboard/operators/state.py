"""KPIs kept as mergeable state per input file, so that a refresh reads only the files that changed.

For every file of a tab's folder the state holds what its rows add to the KPIs: counts, the accumulators of
exact sums, the best row of each extreme (``facts``, one row a file), the sums' cells kept in parts (``cells``)
and how often each value of a median stands there (``counts``). A file is known by its path, length and
modification time: a changed file is a new one, and the state of files that are gone no longer takes part.

``refresh`` lists the folder (names and sizes only), reads the files without state and writes their state, a
partition a file. ``facts`` are written last and mark a file as done, and partitions are replaced whole, so a
refresh that died is simply run again. ``merged`` adds the state of the files listed now.

Rows carry a small number of their file: its identity is worked out once a file. One scan gives a file's counts,
accumulators, best scores and the number of rows with cells kept in parts, all in fixed-width buffers of a hash
aggregate. Only rows at a best score are looked at for their place and label, and only files with such cells are
read for them.

The state of date KPIs holds for one as-of date: keep a state folder a date.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.measures import Best
from ..functions.stats import medians_of_counts, value_counts
from ..session import wide_writes
from ..sources.files import file_id, listing, remove
from ..sources.literal import literal_frame
from ..targets import DEFAULT_TARGETS, Targets
from .kpis import BUNDLE, Family

FILE = "file_id"
#: A file's version as a scan tells it, and the number its rows carry in one refresh.
VERSION = {"__path": "file_path", "__size": "file_size", "__changed": "file_modification_time"}
NUMBER = "__file"
FAR_ROWS = "__far_rows"
CELLS = "i int, k int, v decimal(38,0)"
COUNTS = "name string, x double, c bigint"


def _split(families: list[Family]):
    """(exact sums, other measures, post columns, medians) of families."""
    aggs = [a for f in families for a in f.aggs]
    return ([a for a in aggs if isinstance(a, exact.Sum)], [a for a in aggs if not isinstance(a, exact.Sum)],
            [p for f in families for p in f.post], {n: c for f in families for n, c in f.medians.items()})


def _versions(raw: DataFrame) -> DataFrame:
    """(number, file_id, version...) of the files that give ``raw`` rows; no column of theirs is read."""
    known = raw.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in VERSION.items()]).distinct()
    rows = known.select(file_id(*[F.col(c) for c in VERSION]).alias(FILE), "__path", "__size", F.unix_micros("__changed").alias("__changed")).collect()
    kinds = [(NUMBER, "int"), (FILE, "string"), ("__path", "string"), ("__size", "bigint"), ("__changed", "bigint")]
    return literal_frame(raw.sparkSession, [(i, *r) for i, r in enumerate(sorted(rows))], kinds)


def _numbered(raw: DataFrame, versions: DataFrame) -> DataFrame:
    """``raw`` with the number of each row's file."""
    at = raw.withColumns({c: F.unix_micros(f"_metadata.{m}") if c == "__changed" else F.col(f"_metadata.{m}") for c, m in VERSION.items()})
    return at.join(F.broadcast(versions.drop(FILE)), list(VERSION)).drop(*VERSION)


def _facts(typed: DataFrame, families: list[Family], path: str) -> DataFrame:
    """One row per file, kept at ``path``: what its rows add to counts and sums, the scores of its extremes and how
    many rows have cells kept in parts."""
    sums, others, _, _ = _split(families)
    partial = [c for o in others for c in ([o.first()] if isinstance(o, Best) else o.partial())]
    if sums:
        partial += [c for i in range(len(sums)) for c in exact.accumulators(i)] + [exact.far_rows(len(sums)).alias(FAR_ROWS)]
    exact.with_values(typed, sums).groupBy(NUMBER).agg(*(partial or [F.count(F.lit(1)).alias("__rows")])).write.parquet(path)
    return typed.sparkSession.read.parquet(path)


def _extremes(typed: DataFrame, facts: DataFrame, bests: list[Best]) -> DataFrame:
    """One row per file: the best row of each extreme, among the rows at its score."""
    near = typed.join(F.broadcast(facts.select(NUMBER, *[b.first_name for b in bests])), NUMBER)
    return near.where(reduce(Column.__or__, [b.at_first() for b in bests])).groupBy(NUMBER).agg(*[c for b in bests for c in b.partial()])


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        r = spark.read if schema is None else spark.read.schema(schema)
        return r.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FILE).parquet(path)


def changed_files(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """(path, file_id) of the files in ``folder`` without state."""
    now = listing(spark, folder)
    facts = _read(spark, f"{state}/facts")
    return now if facts is None else now.join(facts.select(FILE).distinct(), FILE, "left_anti")


def refresh(spark: SparkSession, folder: str, state: str, frame: Callable[[DataFrame], DataFrame],
            families: Callable[[DataFrame], list[Family]], schema=None) -> list[str]:
    """Bring ``state`` up to date with the tab's parquet files in ``folder``; returns the paths that were read.

    ``frame`` gives the tab's typed frame, ``families`` its KPIs. ``schema``: of the files (None: read from one
    of them). The paths of changed files come to the driver, as for any read of a list of files."""
    at = {r[FILE]: r["path"] for r in changed_files(spark, folder, state).collect()}
    paths = sorted(at.values())
    if not paths:
        return []
    reader = spark.read if schema is None else spark.read.schema(schema)
    versions = _versions(reader.parquet(*paths))

    def typed_of(some: list[str]) -> DataFrame:
        raw = reader.parquet(*some)
        typed = frame(_numbered(raw, versions))
        return typed if exact.FAR in raw.columns else typed.drop(exact.FAR)

    typed = typed_of(paths)
    fams = families(typed)
    sums, others, _, medians = _split(fams)
    bests = [o for o in others if isinstance(o, Best)]
    ids = F.broadcast(versions.select(NUMBER, FILE))
    kept = f"{state}/found-{uuid.uuid4().hex[:12]}"
    with wide_writes(spark):
        if medians:
            counts = value_counts(typed, medians, (NUMBER,)).select("name", "x", "c", F.col(f"g.{NUMBER}").alias(NUMBER))
            _write(counts.join(ids, NUMBER).select("name", "x", "c", FILE), f"{state}/counts")
        facts = _facts(typed, fams, kept)
        if sums:
            far = sorted(at[r[FILE]] for r in facts.where(F.col(FAR_ROWS) > 0).join(ids, NUMBER).select(FILE).collect() if r[FILE] in at)
            if far:
                cells = exact.cells(exact.with_values(typed_of(far), sums), [F.col(NUMBER)], len(sums))
                _write(cells.join(ids, NUMBER).select("i", "k", "v", FILE), f"{state}/cells")
        if bests:
            facts = facts.join(_extremes(typed, facts, bests), NUMBER, "left")
        facts = facts.join(ids, NUMBER).drop(NUMBER, FAR_ROWS, *[b.first_name for b in bests])
        # files without rows are done too
        done = listing(spark, folder).join(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi").select(FILE)
        _write(done.join(facts, FILE, "left").select(*[c for c in facts.columns if c != FILE], FILE), f"{state}/facts")
    remove(spark, kept)
    return paths


def merged(spark: SparkSession, folder: str, state: str, frame: Callable[[DataFrame], DataFrame],
           families: Callable[[DataFrame], list[Family]], schema) -> DataFrame:
    """The KPIs of the files now in ``folder``, one row, from their state alone."""
    fams = families(frame(spark.createDataFrame([], schema)))
    sums, others, post, medians = _split(fams)
    now = listing(spark, folder).select(FILE)
    facts = _read(spark, f"{state}/facts")
    if facts is None:
        raise ValueError(f"no state in {state}: refresh it first")
    merge = [c for o in others for c in o.merge()] + [c for i in range(len(sums)) for c in exact.merged_accumulators(i)]
    main = facts.join(now, FILE, "left_semi").agg(*(merge or [F.count(F.lit(1)).alias("__rows")]))
    values = main.select("*", *[o.value().alias(f"__v_{o.name}") for o in others])
    keep = [f"__v_{o.name}" for o in others]
    if sums:
        cells = _read(spark, f"{state}/cells", f"{CELLS}, {FILE} string")
        cells = cells.join(now, FILE, "left_semi").drop(FILE) if cells is not None else spark.createDataFrame([], CELLS)
        values = exact.finished(values.crossJoin(exact.side_by_side(exact.added(cells))), sums, keep)  # single rows
    out = values.select(*[F.col(f"__v_{o.name}").alias(o.name) for o in others], *[s.name for s in sums])
    if medians:
        counts = _read(spark, f"{state}/counts", f"{COUNTS}, {FILE} string")
        counts = counts.join(now, FILE, "left_semi") if counts is not None else spark.createDataFrame([], f"{COUNTS}, {FILE} string")
        total = counts.groupBy("name", "x").agg(F.sum("c").alias("c")).select(F.struct(F.lit(0).alias("all")).alias("g"), "name", "x", "c")
        m = medians_of_counts(total, medians)
        out = out.crossJoin(m.select(*[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in medians]))  # single rows
    return out.select(*post)


def refresh_bundle(spark: SparkSession, folders: dict[str, str], state: str, as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> dict[str, list[str]]:
    """``refresh`` of every tab of the bundle (tab -> folder of its parquet files): the paths read, by tab."""
    return {tab: refresh(spark, folders[tab], _state_of(state, tab, as_of), frame, _families(families, as_of, t)) for tab, (frame, families) in BUNDLE.items()}


def bundle_from_state(spark: SparkSession, folders: dict[str, str], state: str, as_of: dt.date, t: Targets = DEFAULT_TARGETS) -> DataFrame:
    """The whole KPI bundle, one row, from the state of the files now in the folders."""
    parts = [merged(spark, folders[tab], _state_of(state, tab, as_of), frame, _families(families, as_of, t), spark.read.parquet(folders[tab]).schema)
             for tab, (frame, families) in BUNDLE.items()]
    return reduce(DataFrame.crossJoin, parts)  # single rows


def _families(families, as_of: dt.date, t: Targets) -> Callable[[DataFrame], list[Family]]:
    return lambda df: families(df, as_of, t)


def _state_of(state: str, tab: str, as_of: dt.date) -> str:
    return f"{state.rstrip('/')}/{tab}/as_of={as_of.isoformat()}"
