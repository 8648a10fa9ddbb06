"""Small literal tables as inline ``VALUES`` (a LocalRelation).

A LocalRelation carries exact size statistics, so the planner broadcasts it
by its real size; a Python-list ``createDataFrame`` would be an RDD scan with
no statistics and force a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql_lit(v, t: str) -> str:
    if v is None:
        return f"CAST(NULL AS {t})"
    if t == "string":
        s = str(v).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{s}'"
    if t in ("double", "float"):
        return f"CAST({float(v)!r} AS DOUBLE)"
    return f"CAST({v} AS {t})"


def literal_frame(spark: SparkSession, rows, columns) -> DataFrame:
    """``columns`` = [(name, spark type name)]; ``rows`` = tuples in that order."""
    names = ", ".join(f"`{n}`" for n, _ in columns)
    if not rows:
        ddl = ", ".join(f"`{n}` {t}" for n, t in columns)
        return spark.createDataFrame([], ddl)
    values = ",\n".join("(" + ", ".join(_sql_lit(v, t) for v, (_, t) in zip(r, columns)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
