"""Scalar cleaning and formatting as native Column expressions.

Every function maps Columns to a Column; nothing here leaves the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Characters removed before a text cell is read as a number (the class [$,%()A-Za-z]);
# ``translate`` removes them without running a regular expression per cell.
NUMBER_JUNK = "$,%()" + string.ascii_letters
# White space at both ends as the reference strips it: Unicode white space and the ASCII separators.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# What reads as a number: no type suffix, nan or infinity.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Characters a plain number is made of: a cell of nothing else is cast as it stands.
PLAIN = "0123456789+-."
#: Typed columns stored beside a tab's text (see the ``*_frame`` functions): header -> column.
TYPED = {
    "Revenue": "__revenue", "Project Health Score": "__health", "Total Project Score": "__total", "eNPS": "__enps",
    "Open Pipeline_Active Work": "__active", "Percieved Annual AMO": "__amo", "Pipeline Score": "__pscore", "Total Deal Score": "__tscore",
    "Impact ($)": "__impact", "Utilization (%)": "__util", "Latest Pulse Score": "__pulse", "Strategic Cost ($)": "__cost",
    "Annualized Impact ($)": "__annual",
}


def _is_numeric(dtype) -> bool:
    """``dtype`` as a DataType or as the type name of ``df.dtypes``."""
    if dtype is None:
        return False
    if isinstance(dtype, NumericType):
        return True
    name = str(dtype)
    return name in ("double", "float", "int", "bigint", "smallint", "tinyint") or name.startswith("decimal")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """The text without white space at both ends (tabs, line breaks and no-break spaces too)."""
    return F.regexp_replace(_c(c), STRIP, "")


def strict_double(c) -> Column:
    """The number that a stripped text spells in full, else null."""
    return F.when(_c(c).rlike(NUMBER), _c(c).try_cast("double"))


def to_number(c, dtype=None) -> Column:
    """Lenient number: never null.

    A numeric column is only cast (NaN counts as missing). Text loses ``$ , % ( )`` and ASCII letters,
    is stripped, ``''`` becomes 0, and what still does not parse becomes 0.
    """
    col = _c(c)
    if _is_numeric(dtype):
        return F.coalesce(F.nanvl(col.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    s = F.translate(col.cast("string"), NUMBER_JUNK, "")
    # nearly every cell is plain by now; only the others are stripped and held against the pattern
    plain = F.translate(s, PLAIN, "") == ""
    return F.coalesce(F.when(plain, s.try_cast("double")).otherwise(strict_double(strip(s))), F.lit(0.0))


def number_of(df: DataFrame, name: str) -> Column:
    """Lenient number of a column by its type in ``df`` (the stored one, where the tab has it); 0 where the
    column is absent."""
    kind = dict(df.dtypes).get(name)
    if kind and TYPED.get(name) in df.columns:
        return F.col(TYPED[name])
    return to_number(F.col(f"`{name}`"), kind) if kind else F.lit(0.0)


def to_date(c) -> Column:
    """ISO date text to DATE; anything else becomes null (never fails the job)."""
    return _c(c).cast("string").try_cast("date")


# Date formats a column may be in, each with the pattern its first value must meet. Numbers
# parted alike read month first unless the first one can't be a month.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "y-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "y-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "y-M-d'T'H:mm:ss"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^(1[3-9]|2\d|3[01])-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^(1[3-9]|2\d|3[01])\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.y"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
)


def dates_by_first(df: DataFrame, columns: dict[str, str], row: str = "_row") -> DataFrame:
    """``df`` with DATE columns: ``columns`` maps each new name to its text column.

    A column's format is that of its first value in sheet order, and every cell is read by it; a cell in another
    format, a day that doesn't exist, and all cells of a column whose first value has none of ``DATE_FORMATS``
    become null. One partial aggregate finds the first values (one row), which is joined back."""
    text = {n: strip(F.col(f"`{c}`").cast("string")) for n, c in columns.items()}
    filled = {n: F.when(t != "", t) for n, t in text.items()}
    # the first filled cell: rows without one come after all others
    first = df.agg(*[F.min_by(t, F.struct(t.isNull().alias("empty"), F.col(row))).alias(f"__first{i}") for i, t in enumerate(filled.values())])
    kinds = []
    for i in range(len(columns)):
        kind = F.lit(None).cast("int")
        for k, (pattern, _) in reversed(list(enumerate(DATE_FORMATS))):
            kind = F.when(F.col(f"__first{i}").rlike(pattern), F.lit(k)).otherwise(kind)
        kinds.append(kind.alias(f"__kind{i}"))
    out = df.crossJoin(F.broadcast(first.select(*kinds)))  # exactly one row
    dates = {}
    for i, (n, t) in enumerate(text.items()):
        date = F.lit(None).cast("date")
        for k, (_, fmt) in reversed(list(enumerate(DATE_FORMATS))):
            date = F.when(F.col(f"__kind{i}") == k, F.try_to_timestamp(t, F.lit(fmt)).cast("date")).otherwise(date)
        dates[n] = date
    return out.withColumns(dates).drop(*[f"__kind{i}" for i in range(len(columns))])


def amo_form_number(c) -> Column:
    """Form-side parse: drop ``$`` and ``,`` only; anything else that fails is 0."""
    return F.coalesce(strict_double(strip(F.translate(_c(c).cast("string"), "$,", ""))), F.lit(0.0))


def status_kpi(c) -> Column:
    """Status as the KPI bundle reads it: stripped and upper case."""
    return F.upper(strip(c))


def status_page(c) -> Column:
    """Status as the project page reads it: upper case, not trimmed."""
    return F.upper(_c(c))


def severity_kpi(c) -> Column:
    return F.lower(_c(c))


def severity_label(c, missing: str = "Unknown") -> Column:
    """First letter upper, the rest lower; a missing cell gets ``missing``."""
    col = _c(c)
    lab = F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))
    return F.coalesce(lab, F.lit(missing))


def is_executive(role) -> Column:
    return F.coalesce(F.lower(_c(role)).contains("executive"), F.lit(False))


def split_list(c) -> Column:
    """Comma list to an array of stripped, distinct names (null cell -> empty)."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: strip(x))
    return F.array_distinct(parts)


def day_diff(end, start) -> Column:
    return F.datediff(_c(end), _c(start)).cast("bigint")


def format_currency(v, missing: str = "N/A") -> Column:
    """``$`` + thousands separators + no decimals, half-even."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(_c(v), 0)), F.lit(missing))


def format_percentage(v, decimals: int = 1, missing: str = "N/A") -> Column:
    """Fixed decimals and ``%``; no thousands separator."""
    txt = F.translate(F.format_number(_c(v), decimals), ",", "")
    return F.coalesce(F.concat(txt, F.lit("%")), F.lit(missing))


def format_num(v, decimals: int = 0, missing: str = "N/A") -> Column:
    return F.coalesce(F.format_number(_c(v), decimals), F.lit(missing))


def date_text(c, missing: str = "N/A") -> Column:
    return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd"), F.lit(missing))


def enum_or(c, allowed, fallback) -> Column:
    """Upper-cased value when it is one of ``allowed``, else ``fallback``."""
    u = F.upper(_c(c))
    return F.when(u.isin(*allowed), u).otherwise(F.lit(fallback))
