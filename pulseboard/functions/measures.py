"""Measures: aggregates that can be worked out at once or merged from parts.

Each measure gives the aggregate Column of the whole (``column``), the Columns a part of the rows keeps
(``partial``), how kept Columns of many parts merge (``merge``) and the value of the merged ones (``value``).
Exact sums are measures too (``functions.exact``); their cells kept in parts and the counts behind medians
travel as rows beside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Count:
    """Rows that meet ``when`` (None: all)."""

    name: str
    when: Column | None = None

    def column(self) -> Column:
        return F.count(F.lit(1) if self.when is None else F.when(self.when, F.lit(1))).alias(self.name)

    def partial(self) -> list[Column]:
        return [self.column()]

    def merge(self) -> list[Column]:
        return [F.coalesce(F.sum(self.name), F.lit(0).cast("bigint")).alias(self.name)]

    def value(self) -> Column:
        return F.col(self.name)


@dataclass
class IntMean:
    """Mean of an integer column; 0 when there are no values."""

    name: str
    of: Column

    def column(self) -> Column:
        return F.coalesce(F.sum(self.of).cast("double") / F.count(self.of), F.lit(0.0)).alias(self.name)

    def partial(self) -> list[Column]:
        return [F.sum(self.of).cast("bigint").alias(f"{self.name}__sum"), F.count(self.of).alias(f"{self.name}__n")]

    def merge(self) -> list[Column]:
        return [F.sum(c).alias(c) for c in (f"{self.name}__sum", f"{self.name}__n")]

    def value(self) -> Column:
        n = F.col(f"{self.name}__n")
        return F.when(n > 0, F.col(f"{self.name}__sum").cast("double") / n).otherwise(F.lit(0.0))


@dataclass
class Best:
    """``label`` of the row with the smallest ``order`` (a struct that no two rows share, its first field ``score``)."""

    name: str
    label: Column
    order: Column
    missing: str

    def column(self) -> Column:
        return F.coalesce(F.min_by(self.label, self.order), F.lit(self.missing)).alias(self.name)

    @property
    def first_name(self) -> str:
        return f"{self.name}__first"

    def first(self) -> Column:
        """The smallest score of a part's rows."""
        return F.min(self.order["score"]).alias(self.first_name)

    def at_first(self) -> Column:
        """Whether a row beside ``first`` can be the best of its part: at that score, or without one (missing scores
        come first in a struct)."""
        return self.order["score"].eqNullSafe(F.col(self.first_name)) | self.order["score"].isNull()

    def partial(self) -> list[Column]:
        return [F.min(F.struct(self.order.alias("order"), self.label.alias("label"))).alias(self.name)]

    def merge(self) -> list[Column]:
        return [F.min(self.name).alias(self.name)]

    def value(self) -> Column:
        return F.coalesce(F.col(self.name)["label"], F.lit(self.missing))


@dataclass
class Const:
    """A fixed value, where the column of a measure is absent."""

    name: str
    fixed: float | int | str

    def _lit(self) -> Column:
        return F.lit(self.fixed).cast("bigint") if isinstance(self.fixed, int) else F.lit(self.fixed)

    def column(self) -> Column:
        return F.max(self._lit()).alias(self.name)

    def partial(self) -> list[Column]:
        return []

    def merge(self) -> list[Column]:
        return []

    def value(self) -> Column:
        return self._lit()
