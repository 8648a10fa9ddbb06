"""DuckDB SQL forms of the column functions (oracle side only)."""

from __future__ import annotations

from .driver_sql import D, lit, qi  # noqa: F401  (re-exported)


def num(col: str) -> str:
    """Lenient number of a text column: read as a decimal from what a number may hold, so that it does not
    lean on the rules of ``functions.clean.to_number``."""
    s = f"regexp_replace({col}, '[^0-9.+ -]', '', 'g')"
    return f"COALESCE(CAST(TRY_CAST(CASE WHEN {s} <> '' THEN {s} END AS DECIMAL(38,10)) AS DOUBLE), 0.0)"


def dte(col: str) -> str:
    return f"TRY_CAST({col} AS DATE)"


def dsum(x: str, scale: int = 6) -> str:
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(26,{scale}))) AS DOUBLE), 0.0)"


def dmean(x: str, scale: int = 6) -> str:
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(26,{scale}))) AS DOUBLE) / COUNT({x}), 0.0)"


def xsum(x: str, scale: int = 14) -> str:
    """Sum of all digits of doubles that hold at most ``scale`` places, read from their text."""
    return f"COALESCE(CAST(CAST(SUM(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,{scale}))) AS VARCHAR) AS DOUBLE), 0.0)"


def imean(x: str) -> str:
    return f"COALESCE(CAST(SUM({x}) AS DOUBLE) / COUNT({x}), 0.0)"


def med(x: str) -> str:
    return f"COALESCE(round(CAST(median({x}) AS DOUBLE), 9), 0.0)"


def cnt(cond: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def days(end: str, start: str) -> str:
    return f"CAST(date_diff('day', {start}, {end}) AS BIGINT)"


def money0(x: str) -> str:
    """``$`` + thousands + no decimals (mirror of ``format_currency``)."""
    return f"COALESCE('$' || format('{{:,.0f}}', {x}), 'N/A')"
