"""Exact sums of DOUBLE columns: every value counts with all its digits, in any order, at any size.

A double stands for the shortest decimal that spells it. Most cells (below 10^11, at most four places) are whole
numbers of ten-thousandths: three BIGINT accumulators of five digits each add them up in the same aggregate as
the job's other columns, inside generated code. The other cells, far larger or finer, are taken apart into
parts of nine digits, each of a class: its power of 10^9. Parts are added as integers per class (partial
aggregates; no class can overflow), and at the end, once per group, the classes are carried into one another,
the whole is spelt out and read as a double: rounded once, whatever cancelled.

The rows with such cells come from a second, narrow scan; tabs stored with a ``__far`` mark let the scan skip
every row group that has none, other tabs are looked through for them.

Expressions are SQL text, since a text is parsed at once where nested lambdas built by calls take a second.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 4
UNITS = 10**PLACES  # a near value is a whole number of 1/UNITS
NEAR = 1e11
SPLIT = 10**5  # digits of one accumulator: 9 * 10^13 rows before a BIGINT is full
DIGITS = 9
#: Stored beside a tab's typed numbers: whether one of them is kept in parts.
FAR = "__far"


@dataclass
class Sum:
    """Exact sum of a DOUBLE column under ``name``; ``empty`` when there are no values."""

    name: str
    column: Column
    empty: float | None = 0.0

    def result(self, total: Column, n: Column) -> Column:
        return F.when(n > 0, total).otherwise(F.lit(self.empty).cast("double"))


@dataclass
class Mean(Sum):
    """Exact sum of the values over their number."""

    def result(self, total: Column, n: Column) -> Column:
        return F.when(n > 0, total / n).otherwise(F.lit(self.empty).cast("double"))


def _special(x: str) -> str:
    return f"(isnan({x}) OR abs({x}) = double('infinity'))"


def _near(x: str) -> str:
    """``x`` in units where that is the whole value, else null."""
    return f"IF(abs({x}) < {NEAR:.0f}D AND rint({x} * {UNITS}D) / {UNITS}D = {x}, cast(rint({x} * {UNITS}D) AS bigint), NULL)"


def _is_far(x: str) -> str:
    return f"coalesce(NOT {_special(x)} AND NOT (abs({x}) < {NEAR:.0f}D AND rint({x} * {UNITS}D) / {UNITS}D = {x}), false)"


def far_mark(*columns: str) -> Column:
    """Whether a finite value of these DOUBLE columns is kept in parts."""
    return F.expr(" OR ".join(_is_far(f"`{c}`") for c in columns))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cut(first: str, text: str, sign: str, n: int) -> str:
    """The last 9n digits of ``text`` as parts from class ``first`` up."""
    return "array(" + ", ".join(
        f"named_struct('k', {first} + {j}, 'v', cast({sign} * cast(substring({text}, {DIGITS * (n - 1 - j) + 1}, {DIGITS}) AS int) AS decimal(38,0)))" for j in range(n)) + ")"


def _parts(x: str) -> str:
    """A finite double as signed nine-digit parts (k, v): the value is the sum of v * 10^(9k)."""
    lowest = "IF(contains(s, 'E'), cast(substring_index(s, 'E', -1) AS int), 0) - (length(m) - instr(m, '.'))"  # power of ten of the last digit
    text = f"lpad(concat(translate(m, '.', ''), repeat('0', pmod(e, {DIGITS}))), {4 * DIGITS}, '0')"
    cut = _let(text, "t", _cut(f"cast((e - pmod(e, {DIGITS})) / {DIGITS} AS int)", "t", f"cast(signum({x}) AS int)", 4))
    return f"filter({_let(f'cast(abs({x}) AS string)', 's', _let(chr(39).join(['substring_index(s, ', 'E', ', 1)']), 'm', _let(lowest, 'e', cut)))}, p -> p.v <> 0)"


def _whole_parts(total: str) -> str:
    """Parts of a whole decimal number of units."""
    below = f"named_struct('k', -1, 'v', cast(pmod({total}, {UNITS}) * {10 ** (DIGITS - PLACES)} AS decimal(38,0)))"
    text = f"lpad(cast(abs(w) AS string), {5 * DIGITS}, '0')"
    above = _let(f"cast(floor(({total} - pmod({total}, {UNITS})) / {UNITS}) AS decimal(38,0))", "w", _let(text, "t", _cut("0", "t", "cast(signum(w) AS int)", 5)))
    return f"concat(array({below}), {above})"


def _spelt(parts: str) -> str:
    """The double nearest to the sum of an array of parts."""
    base = f"{10**DIGITS}BD"

    def carried(sign: str) -> str:
        """The classes from the lowest up: the open sum of the last (t) and the digits of those below it (text)."""
        here = f"reduce(filter(ps, p -> p.k = k), cast(0 AS decimal(38,0)), (s, p) -> cast(s {sign} p.v AS decimal(38,0)))"
        step = (f"named_struct('t', cast(cast((acc.t - pmod(acc.t, {base})) / {base} AS decimal(38,0)) + {here} AS decimal(38,0)), "
                f"'text', concat(lpad(cast(cast(pmod(acc.t, {base}) AS decimal(38,0)) AS string), {DIGITS}, '0'), acc.text))")
        # four classes more than the highest hold any carry
        return f"reduce(sequence(low, array_max(transform(ps, p -> p.k)) + 4), named_struct('t', cast(0 AS decimal(38,0)), 'text', ''), (acc, k) -> {step})"

    text = _let(carried("+"), "up", f"IF(up.t < 0, concat('-', {carried('-')}.text), up.text)")
    # the first step writes the digits of the sum's start: nine zeros below the lowest class
    whole = _let("array_min(transform(ps, p -> p.k))", "low", f"concat({text}, 'E', cast((low - 1) * {DIGITS} AS string))")
    return f"try_cast({_let(parts, 'ps', whole)} AS double)"


def _total(units: str, far: str) -> str:
    """The double of a whole number of units and the parts beside it."""
    near = f"cast({units} * {10**-PLACES:.{PLACES}f}BD AS double)"
    return f"IF(coalesce(size({far}), 0) <= 0, {near}, {_spelt(f'concat({_whole_parts(units)}, {far})')})"


def accumulators(i: int) -> list[Column]:
    """Aggregates of the near values of column ``__x{i}``."""
    x, n = f"__x{i}", _near(f"__x{i}")
    return [F.expr(f"sum({n} div {SPLIT**2})").alias(f"__high{i}"), F.expr(f"sum({n} div {SPLIT} % {SPLIT})").alias(f"__mid{i}"), F.expr(f"sum({n} % {SPLIT})").alias(f"__low{i}"),
            F.expr(f"sum(IF({_special(x)}, {x}, NULL))").alias(f"__odd{i}"), F.expr(f"count({x})").alias(f"__n{i}")]


def far_rows(n: int) -> Column:
    """Aggregate: how many rows have a value of ``__x0`` to ``__x{n-1}`` that is kept in parts."""
    return F.expr("count_if(" + " OR ".join(_is_far(f"__x{i}") for i in range(n)) + ")")


def merged_accumulators(i: int) -> list[Column]:
    """What ``accumulators`` of many parts come to; the digits are carried by ``finished``."""
    wide = [F.expr(f"sum(cast(__{c}{i} AS decimal(28,0)))").alias(f"__{c}{i}") for c in ("high", "mid", "low")]
    return [*wide, F.sum(f"__odd{i}").alias(f"__odd{i}"), F.coalesce(F.sum(f"__n{i}"), F.lit(0)).alias(f"__n{i}")]


def with_values(df: DataFrame, sums: list[Sum]) -> DataFrame:
    return df.withColumns({f"__x{i}": s.column.cast("double") for i, s in enumerate(sums)})


def cells(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """(keys..., i, k, v): the cells of ``__x0`` to ``__x{n-1}`` that are kept in parts, added per class."""
    none = "cast(array() AS array<struct<i:int,k:int,v:decimal(38,0)>>)"
    each = [f"IF({_is_far(f'__x{i}')}, transform({_parts(f'__x{i}')}, p -> named_struct('i', {i}, 'k', p.k, 'v', p.v)), {none})" for i in range(n)]
    # without a stored mark every row is looked at here: as a filter the test would move below the columns it reads
    # and work each of them out once per mention
    rows = df.where(F.col(FAR)) if FAR in df.columns else df
    return added(rows.select(*keys, F.expr(f"inline(concat({', '.join(each)}))")))


def added(parts: DataFrame) -> DataFrame:
    """Rows (keys..., i, k, v) with ``v`` added per class."""
    return parts.groupBy(*[c for c in parts.columns if c != "v"]).agg(F.expr("cast(sum(cast(v AS decimal(28,0))) AS decimal(38,0))").alias("v"))


def side_by_side(parts: DataFrame) -> DataFrame:
    """The classes of each group in one array: some 75 a sum at most."""
    return parts.groupBy(*[c for c in parts.columns if c not in ("i", "k", "v")]).agg(F.expr("collect_list(struct(i, k, v))").alias("__parts"))


def finished(joined: DataFrame, sums: list[Sum], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the sums, from accumulators and ``__parts``."""
    out = [F.col(f"`{c}`") for c in keep]
    for i, s in enumerate(sums):
        units = f"cast(coalesce(__high{i} * {SPLIT**2}BD + __mid{i} * {SPLIT}BD + __low{i}, 0) AS decimal(38,0))"
        far = f"transform(filter(__parts, p -> p.i = {i}), p -> named_struct('k', p.k, 'v', p.v))"
        out.append(s.result(F.expr(f"coalesce(__odd{i}, {_total(units, far)})"), F.col(f"__n{i}")).alias(s.name))
    return joined.select(*out)


def aggregate(df: DataFrame, by, aggs) -> DataFrame:
    """``df`` grouped by the columns named in ``by`` (none: one row), with ``aggs``: aggregate Columns as they are
    and ``Sum`` / ``Mean``. NaN and infinities add up as doubles do."""
    keys = [F.col(f"`{b}`") for b in by]
    sums = [a for a in aggs if isinstance(a, Sum)]
    plain = [a for a in aggs if not isinstance(a, Sum)]
    if not sums:
        return df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("__rows")]))
    df = with_values(df, sums)
    main = df.groupBy(*keys).agg(*plain, *[c for i in range(len(sums)) for c in accumulators(i)])
    names = [f"__by{j}" for j in range(len(keys))]
    side = side_by_side(cells(df, [k.alias(n) for k, n in zip(keys, names, strict=True)], len(sums)))
    if keys:
        joined = main.join(side, reduce(Column.__and__, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]), "left")
    else:
        joined = main.crossJoin(side)  # both sides are global aggregates: exactly one row each
    return finished(joined, sums, main.columns[:len(keys) + len(plain)])


def row_sum(columns) -> Column:
    """Exact sum of the DOUBLE columns named, over one row, nulls left out; 0 without values."""
    names = [f"`{c}`" for c in columns]
    if not names:
        return F.lit(0.0)
    units = "cast(" + " + ".join(f"coalesce({_near(x)}, 0)" for x in names) + " AS decimal(38,0))"
    odd = " + ".join(f"IF({_special(x)}, {x}, 0D)" for x in names)
    none = "cast(array() AS array<struct<k:int,v:decimal(38,0)>>)"
    far = "concat(" + ", ".join(f"IF({_is_far(x)}, {_parts(x)}, {none})" for x in names) + ")"
    is_odd = " OR ".join(f"coalesce({_special(x)}, false)" for x in names)
    return F.expr(f"CASE WHEN {is_odd} THEN {odd} WHEN {' OR '.join(_is_far(x) for x in names)} THEN {_total(units, far)} ELSE cast({units} * {10**-PLACES:.{PLACES}f}BD AS double) END")
