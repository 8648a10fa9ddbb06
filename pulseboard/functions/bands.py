"""Score bands: first band whose closed range holds the score, else ``N/A``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "N/A"


def band(score: Column, bands) -> Column:
    """``bands`` = ((name, low, high), ...); gaps between bands are real."""
    expr = None
    for name, low, high in bands:
        cond = score.between(F.lit(float(low)), F.lit(float(high)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(NA))
