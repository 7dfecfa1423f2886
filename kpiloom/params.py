"""One parameter object shared by every operator (grain, date range, clock, segment)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo

from kpiloom.dates import date_range

GRAINS = ("daily", "monthly", "cumulative", "weekly")


@dataclass(frozen=True)
class Params:
    # daily | monthly | cumulative | weekly; anything else behaves as daily
    grain: str = "daily"
    # optional date field filter: [date_from, date_to) on the operator's date column
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    # the report clock: "today" in the business time zone; ranges end before it
    as_of: dt.date | None = None
    tz: str = "Asia/Riyadh"
    # anchor of 7-day buckets (weekly grain) and start of the weekly scoreboards
    anchor: dt.date = dt.date(2024, 1, 1)
    # optional account filter (B2B username) and month filter 'YYYY-MM'
    account: str | None = None
    # compare and group account names case-insensitively (UTF8_LCASE collation), as a
    # case-insensitive source collation does
    ci_text: bool = False
    month: str | None = None
    # segment / geography / offer id sets
    b2b_ids: tuple[int, ...] = (3, 7, 11, 14)
    city_id: int = 2
    area_ids: tuple[int, ...] = (2, 7, 12)
    offer_package_ids: tuple[int, ...] = (15, 40, 120)
    # trailing windows (days) of the rolling reports
    last_days: int | None = None
    # idle gap kept by the between-jobs metric, in minutes
    max_gap_minutes: int = 180
    # weeks of the indicator matrix, from the anchor on
    n_weeks: int = 13

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def today(self) -> dt.date:
        """as_of, or the current date in the business time zone (computed once, on the driver)."""
        if self.as_of is not None:
            return self.as_of
        return dt.datetime.now(ZoneInfo(self.tz)).date()

    def dated(self, option: str | None, first_weekday: int = 0) -> "Params":
        """With the date filter of an option such as 'past 30 days', relative to ``today`` (see dates.py)."""
        lo, hi = date_range(option, self.today, first_weekday)
        return replace(self, date_from=lo, date_to=hi)

    @property
    def month_start(self) -> dt.date:
        return self.today.replace(day=1)

    @property
    def effective_grain(self) -> str:
        return self.grain if self.grain in GRAINS else "daily"

    def weeks(self) -> list[dt.date]:
        return [self.anchor + dt.timedelta(days=7 * i) for i in range(self.n_weeks)]

    def month_bounds(self) -> tuple[dt.date, dt.date] | None:
        if not self.month:
            return None
        y, m = (int(x) for x in self.month.split("-"))
        lo = dt.date(y, m, 1)
        hi = dt.date(y + (m == 12), m % 12 + 1, 1)
        return lo, hi


# Fixture clock of the test tables (see FIXTURES.md).
FIXTURE = Params(as_of=dt.date(2024, 1, 31), anchor=dt.date(2024, 1, 1))
