"""Date options of a report's date filter, relative to the report clock.

    past 30 days            the 30 whole days before today         past 2 weeks including today
    this quarter            from its first day to its last          previous month
    today, yesterday        one day                                 2024-01-05
    since 2024-01-05        from a day on                           until 2024-01-31 (that day included)
    2024-01-05 to 2024-01-31, both included                         2024-01, 2024 Q1, 2024

Units are days, weeks, months, quarters and years. ``past n units`` are n whole units that end before the one that
holds today; ``including this unit`` (or ``including today`` for days) adds that one, up to its end. ``this unit`` is the
whole of it, days to come included, as a filter on creation times finds none there.
"""

from __future__ import annotations

import datetime as dt
import re

UNITS = ("day", "week", "month", "quarter", "year")

_DAY = r"\d{4}-\d{2}-\d{2}"
_UNIT = r"(day|week|month|quarter|year)s?"
_PAST = re.compile(rf"(?:past|last|previous) (?:(\d+) )?{_UNIT}(?: including (?:today|this (?:day|week|month|quarter|year)))?")
_NEXT = re.compile(rf"next (?:(\d+) )?{_UNIT}")


def start_of(day: dt.date, unit: str, first_weekday: int = 0) -> dt.date:
    """First day of the unit that holds ``day``. ``first_weekday``: 0 for Monday to 6 for Sunday."""
    if unit == "week":
        return day - dt.timedelta(days=(day.weekday() - first_weekday) % 7)
    if unit == "month":
        return day.replace(day=1)
    if unit == "quarter":
        return dt.date(day.year, day.month - (day.month - 1) % 3, 1)
    return dt.date(day.year, 1, 1) if unit == "year" else day


def moved(day: dt.date, n: int, unit: str) -> dt.date:
    """The first day of a unit, moved by n units."""
    if unit in ("day", "week"):
        return day + dt.timedelta(days=n * (7 if unit == "week" else 1))
    months = day.year * 12 + day.month - 1 + n * {"month": 1, "quarter": 3, "year": 12}[unit]
    return dt.date(months // 12, months % 12 + 1, 1)


def date_range(option: str | None, today: dt.date, first_weekday: int = 0) -> tuple[dt.date | None, dt.date | None]:
    """[from, to) of an option; None is no bound. An option that is none of the forms above raises ValueError."""
    text = " ".join((option or "").lower().split())
    one = dt.timedelta(days=1)
    if text in ("", "all time"):
        return None, None
    if text in ("today", "yesterday"):
        day = today - one * (text == "yesterday")
        return day, day + one
    if m := re.fullmatch(rf"this {_UNIT}", text):
        first = start_of(today, m[1], first_weekday)
        return first, moved(first, 1, m[1])
    if m := _PAST.fullmatch(text):
        first = start_of(today, m[2], first_weekday)
        return moved(first, -int(m[1] or 1), m[2]), moved(first, 1, m[2]) if "including" in text else first
    if m := _NEXT.fullmatch(text):
        first = moved(start_of(today, m[2], first_weekday), 1, m[2])
        return first, moved(first, int(m[1] or 1), m[2])
    if m := re.fullmatch(rf"since ({_DAY})", text):
        return dt.date.fromisoformat(m[1]), None
    if m := re.fullmatch(rf"until ({_DAY})", text):
        return None, dt.date.fromisoformat(m[1]) + one
    if m := re.fullmatch(rf"({_DAY})(?: to ({_DAY}))?", text):
        return dt.date.fromisoformat(m[1]), dt.date.fromisoformat(m[2] or m[1]) + one
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2})| q([1-4]))?", text):
        unit = "month" if m[2] else "quarter" if m[3] else "year"
        first = dt.date(int(m[1]), int(m[2] or 3 * int(m[3] or 1) - 2), 1)
        return first, moved(first, 1, unit)
    raise ValueError(f"unknown date option {option!r}")
