"""Date options over the borders of weeks, months, quarters and years."""

import datetime as dt

import pytest

from kpiloom.dates import date_range
from kpiloom.params import FIXTURE, Params


def d(text):
    return dt.date.fromisoformat(text) if text else None


CASES = [  # option, today, from, to (excluded)
    ("past 30 days", "2024-03-10", "2024-02-09", "2024-03-10"),
    ("Past  1 Day", "2024-03-01", "2024-02-29", "2024-03-01"),
    ("past 30 days including today", "2024-03-10", "2024-02-09", "2024-03-11"),
    ("past 2 weeks", "2024-01-10", "2023-12-25", "2024-01-08"),
    ("past 2 weeks including this week", "2024-01-10", "2023-12-25", "2024-01-15"),
    ("previous week", "2024-01-01", "2023-12-25", "2024-01-01"),
    ("last month", "2024-03-31", "2024-02-01", "2024-03-01"),
    ("previous month", "2024-01-15", "2023-12-01", "2024-01-01"),
    ("past 14 months", "2024-01-31", "2022-11-01", "2024-01-01"),
    ("previous quarter", "2024-02-29", "2023-10-01", "2024-01-01"),
    ("past 5 quarters including this quarter", "2024-12-31", "2023-07-01", "2025-01-01"),
    ("past 3 years", "2024-02-29", "2021-01-01", "2024-01-01"),
    ("this day", "2024-02-29", "2024-02-29", "2024-03-01"),
    ("this week", "2023-12-31", "2023-12-25", "2024-01-01"),
    ("this month", "2024-02-29", "2024-02-01", "2024-03-01"),
    ("this quarter", "2024-12-31", "2024-10-01", "2025-01-01"),
    ("this year", "2024-01-01", "2024-01-01", "2025-01-01"),
    ("next 7 days", "2024-02-25", "2024-02-26", "2024-03-04"),
    ("next month", "2024-12-05", "2025-01-01", "2025-02-01"),
    ("today", "2024-12-31", "2024-12-31", "2025-01-01"),
    ("yesterday", "2024-01-01", "2023-12-31", "2024-01-01"),
    ("since 2024-02-29", "2024-05-01", "2024-02-29", None),
    ("until 2024-02-29", "2024-05-01", None, "2024-03-01"),
    ("2024-02-29", "2024-05-01", "2024-02-29", "2024-03-01"),
    ("2023-12-30 to 2024-01-02", "2024-05-01", "2023-12-30", "2024-01-03"),
    ("2023-12", "2024-05-01", "2023-12-01", "2024-01-01"),
    ("2024 q4", "2024-05-01", "2024-10-01", "2025-01-01"),
    ("2024", "2024-05-01", "2024-01-01", "2025-01-01"),
    ("all time", "2024-05-01", None, None),
    (None, "2024-05-01", None, None),
]


@pytest.mark.parametrize("option, today, lo, hi", CASES)
def test_options(option, today, lo, hi):
    assert date_range(option, d(today)) == (d(lo), d(hi))


def test_weeks_that_start_on_another_day():
    sunday = dt.date(2024, 1, 7)
    assert date_range("this week", sunday) == (dt.date(2024, 1, 1), dt.date(2024, 1, 8))
    assert date_range("this week", sunday, 6) == (dt.date(2024, 1, 7), dt.date(2024, 1, 14))
    assert date_range("previous week", sunday, 6) == (dt.date(2023, 12, 31), dt.date(2024, 1, 7))


@pytest.mark.parametrize("option", ["past", "this", "2024-13", "2024-02-30", "2024 q5", "soon", "past -1 days", "since"])
def test_anything_else_is_an_error(option):
    with pytest.raises(ValueError):
        date_range(option, dt.date(2024, 5, 1))


def test_clock_and_time_zone():
    p = FIXTURE.dated("past 7 days")
    assert (p.date_from, p.date_to) == (dt.date(2024, 1, 24), dt.date(2024, 1, 31))
    far = Params(tz="Pacific/Kiritimati").dated("today")
    near = Params(tz="Pacific/Midway").dated("today")
    assert far.date_from - near.date_from in (dt.timedelta(days=1), dt.timedelta(days=2))
