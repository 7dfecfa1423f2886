"""Scalar and aggregate idioms of the reports, as JVM-side Column expressions.

All helpers return built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "c", "live", "dec", "bsum", "ratio", "pct", "rnd", "rnd_dec", "to_dbl", "day", "day_str",
    "month_start", "week_start", "week_str", "period", "in_range", "ts_lit", "date_lit",
    "minutes_between", "hours_between", "time_of_day", "tod_wraps", "json_text", "apply_date_filter",
]


# The number that a text starts with.
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def live(df: DataFrame, col: str = "deleted_at") -> DataFrame:
    """Soft-delete filter (``deleted_at IS NULL``)."""
    return df.where(F.col(col).isNull())


def dec(x: str | Column, precision: int = 12, scale: int = 2) -> Column:
    """Text -> DECIMAL like the source database: NULL stays NULL, a leading number counts ('12.5abc' is
    12.5), text without one is 0, and what the type cannot hold becomes its largest value of that sign."""
    x = c(x)
    t = f"decimal({precision},{scale})"
    top = Decimal(10 ** precision - 1).scaleb(-scale)
    lead = F.regexp_extract(x.cast("string"), LEADING_NUMBER, 1)
    size = lead.try_cast("double")
    clamped = (F.when(size >= float(top), F.lit(top)).when(size <= -float(top), F.lit(-top))
               .otherwise(F.lit(Decimal(0))).cast(t))
    # the first cast settles clean text; the rest is evaluated for other text only
    return F.when(x.isNotNull(), F.coalesce(x.try_cast(t), lead.try_cast(t), clamped))


def bsum(cond: Column) -> Column:
    """SUM(<boolean>): counts TRUE, skips NULL, NULL when every value is NULL."""
    return F.sum(cond.cast("int"))


def to_dbl(x: str | Column) -> Column:
    return c(x).cast("double")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / NULLIF(b, 0) evaluated in double precision (never raises under ANSI)."""
    return to_dbl(a) / F.nullif(to_dbl(b), F.lit(0.0))


def rnd(x: str | Column, n: int) -> Column:
    """ROUND half away from zero, made stable by rounding a decimal(18,6), not a double."""
    return F.round(c(x).cast("decimal(18,6)"), n).cast("double")


def rnd_dec(x: str | Column, n: int) -> Column:
    """ROUND of an exact decimal (money sums), returned as double."""
    return F.round(c(x), n).cast("double")


def pct(a: str | Column, b: str | Column, n: int = 1) -> Column:
    """ROUND(100*a/NULLIF(b,0), n)."""
    return rnd(ratio(c(a) * 100, b), n)


def ts_lit(d: dt.date | dt.datetime | str) -> Column:
    if isinstance(d, dt.date) and not isinstance(d, dt.datetime):
        d = dt.datetime(d.year, d.month, d.day)
    return F.lit(d).cast("timestamp")


def date_lit(d: dt.date | str) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else F.lit(d)


def in_range(col: str | Column, lo=None, hi=None) -> Column:
    """Half-open [lo, hi) on a timestamp column with date bounds (sargable: pushed to Parquet)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c(col) >= ts_lit(lo))
    if hi is not None:
        cond = cond & (c(col) < ts_lit(hi))
    return cond


def apply_date_filter(df: DataFrame, col: str, p) -> DataFrame:
    """Field filter {{date}}: unset bounds mean no filter."""
    if p.date_from is None and p.date_to is None:
        return df
    return df.where(in_range(col, p.date_from, p.date_to))


def day(x: str | Column) -> Column:
    return F.to_date(c(x))


def day_str(x: str | Column) -> Column:
    return F.date_format(c(x), "yyyy-MM-dd")


def month_start(x: str | Column) -> Column:
    return F.trunc(F.to_date(c(x)), "MM")


def week_start(x: str | Column, anchor: dt.date) -> Column:
    """Start of the 7-day bucket anchored at ``anchor``; a true floor, so earlier dates get
    negative weeks: DATE_ADD(anchor, FLOOR(DATEDIFF(x, anchor)/7)*7)."""
    a = F.lit(anchor)
    return F.date_add(a, (F.floor(F.datediff(F.try_to_date(c(x)), a) / 7) * 7).cast("int"))


def week_str(x: str | Column, anchor: dt.date) -> Column:
    return F.date_format(week_start(x, anchor), "yyyy-MM-dd")


def period(x: str | Column, grain: str, anchor: dt.date | None = None) -> Column:
    """Period key of a grain: day for daily/cumulative, month start, or anchored week."""
    if grain == "monthly":
        return month_start(x)
    if grain == "weekly":
        return week_start(x, anchor)
    return day(x)


def minutes_between(a: str | Column, b: str | Column) -> Column:
    """TIMESTAMPDIFF(MINUTE, a, b): whole minutes, truncated toward zero."""
    return F.timestamp_diff("MINUTE", c(a), c(b))


def hours_between(a: str | Column, b: str | Column) -> Column:
    return F.timestamp_diff("HOUR", c(a), c(b))


def time_of_day(x: str | Column) -> Column:
    return F.date_format(c(x), "HH:mm:ss")


def tod_wraps(x: str | Column, start: str, end: str) -> Column:
    """Time of day in a window that wraps midnight: >= start OR < end."""
    t = time_of_day(x)
    return (t >= F.lit(start)) | (t < F.lit(end))


def json_text(x: str | Column, path: str) -> Column:
    """JSON_UNQUOTE(JSON_EXTRACT(x, path)); NULL for JSON null or malformed input."""
    return F.get_json_object(c(x), path)
