"""Order-independent aggregates: counts, means of integers and exact medians (sums: ``functions.exact``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def imean(c: Column) -> Column:
    """Mean of an integer column; 0 when there are none."""
    return F.coalesce(F.sum(c).cast("double") / F.count(c), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _bucket(x: Column) -> Column:
    """A number that rises with ``x``: 256 steps an octave, so no bucket holds a large share of unlike values."""
    size = F.floor(F.log2(F.abs(x)) * 256).cast("bigint") + 300_000
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.signum(x).cast("bigint") * size)


def medians(df: DataFrame, columns: dict[str, Column], by=()) -> DataFrame:
    """Exact medians (nulls ignored), one row per group: by..., one column per name (null without values),
    rounded to 9 decimals.

    Equal values are counted first (partial aggregates), the totals of buckets of neighbouring values run up
    per group and name, and only the one or two buckets that hold the middle ranks are looked at value by
    value: no task sees all values of a group, and nothing runs before the result is asked for."""
    return medians_of_counts(value_counts(df, columns, by), columns, by)


def value_counts(df: DataFrame, columns: dict[str, Column], by=()) -> DataFrame:
    """(g, name, x, c): how often each value of each column stands in each group (g: struct of ``by``)."""
    keys = [f"__g{j}" for j in range(len(by))]
    values = F.array(*[c.cast("double") for c in columns.values()])
    # rows are counted by the place of a column's name, not by its text
    long = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], F.posexplode(values).alias("__at", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = long.groupBy(*keys, "__at", "x").agg(F.count(F.lit(1)).alias("c"))
    group = F.struct(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.lit(0).alias("all"))
    return counts.select(group.alias("g"), F.element_at(F.array(*[F.lit(n) for n in columns]), F.col("__at") + 1).alias("name"), "x", "c")


def medians_of_counts(counts: DataFrame, columns, by=()) -> DataFrame:
    """The medians of ``medians`` from counted values (g, name, x, c)."""
    # both uses below then ask for the same rows (the join's own tests are here already), so the values are counted once
    counts = counts.withColumn("bucket", _bucket(F.col("x"))).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("g", "name", "bucket")]))
    low, high = Window.unboundedPreceding, Window.currentRow
    totals = counts.groupBy("g", "name", "bucket").agg(F.sum("c").alias("t"))
    group = Window.partitionBy("g", "name")  # buckets of a group: some thousand an octave range, whatever the rows
    places = totals.withColumns({"upto": F.sum("t").over(group.orderBy("bucket").rowsBetween(low, high)), "n": F.sum("t").over(group)})
    middle = [F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1]

    def holds(first: Column, last: Column) -> Column:
        return reduce(Column.__or__, [(first < k) & (k <= last) for k in middle])

    target = places.select("g", "name", "bucket", "n", (F.col("upto") - F.col("t")).alias("before"), "upto").where(holds(F.col("before"), F.col("upto"))).drop("upto")
    near = counts.join(target, ["g", "name", "bucket"])
    run = near.withColumn("to", F.col("before") + F.sum("c").over(Window.partitionBy("g", "name", "bucket").orderBy("x").rowsBetween(low, high)))
    kept = run.where(holds(F.col("to") - F.col("c"), F.col("to")))
    one = kept.groupBy("g", "name").agg(F.round((F.min("x") + F.max("x")) / 2.0, 9).alias("m"))
    wide = [F.max(F.when(F.col("name") == n, F.col("m"))).alias(n) for n in columns]
    if not by:
        return one.agg(*wide)
    return one.groupBy("g").agg(*wide).select(*[F.col("g")[b].alias(b) for b in by], *columns)
