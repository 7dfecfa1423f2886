"""SQL snippets shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

import datetime as dt


def d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def ts(x: dt.date) -> str:
    return f"TIMESTAMP '{x.isoformat()} 00:00:00'"


def s(x: dt.date) -> str:
    return f"'{x.isoformat()}'"


def ids(xs) -> str:
    return ", ".join(str(int(v)) for v in xs)


def dec(col: str, p: int = 12, sc: int = 2) -> str:
    return f"(CASE WHEN {col} IS NOT NULL THEN coalesce(try_cast({col} AS DECIMAL({p},{sc})), 0) END)"


def rnd(x: str, n: int) -> str:
    return f"cast(round(cast({x} AS DECIMAL(18,6)), {n}) AS DOUBLE)"


def rdec(x: str, n: int) -> str:
    return f"cast(round({x}, {n}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(cast({a} AS DOUBLE) / nullif(cast({b} AS DOUBLE), 0))"


def week(x: str, anchor: dt.date) -> str:
    return (f"cast({d(anchor)} + cast(floor(date_diff('day', {d(anchor)}, try_cast({x} AS DATE)) / 7) * 7 AS INTEGER)"
            f" AS DATE)")


def period(x: str, grain: str, anchor: dt.date) -> str:
    if grain == "monthly":
        return f"cast(date_trunc('month', {x}) AS DATE)"
    if grain == "weekly":
        return week(x, anchor)
    return f"cast({x} AS DATE)"


def date_filter(col: str, p) -> str:
    out = ""
    if p.date_from is not None:
        out += f" AND {col} >= {ts(p.date_from)}"
    if p.date_to is not None:
        out += f" AND {col} < {ts(p.date_to)}"
    return out


def minutes(a: str, b: str) -> str:
    # whole minutes truncated toward zero (date_sub, not date_diff)
    return f"date_sub('minute', {a}, {b})"


def hours(a: str, b: str) -> str:
    return f"date_sub('hour', {a}, {b})"
