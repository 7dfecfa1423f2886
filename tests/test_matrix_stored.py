"""The registered weekly matrices over stored tables with more than ten digits of sales a week."""

import datetime as dt

import pytest

from __spark_entry__ import queries
from kpiloom.sources.tables import RAW_SCHEMAS

DAY0, PRICE, CENTS = dt.date(2024, 1, 1), 999_999_999.0, 9_999_999_990  # a package costs a tenth of its order


@pytest.fixture(scope="module")
def large_orders(spark, tmp_path_factory) -> str:
    """30 paid orders of each day of January, bought by a few clients; those with keys divisible by 10 are deleted."""
    d, at = tmp_path_factory.mktemp("large_orders"), dt.datetime(2024, 1, 12, 9)
    rows = {
        "orders": [(k, k % 7, "F", PRICE, at, "1-URGENT") for k in range(900)],
        "events": [(1, at, 3, "view", 5.0, '{"k": 10}')],  # a wash from a package: no sales
        "customer": [(1, "c1", 0, 0.0, "MACHINERY")],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, RAW_SCHEMAS[name]).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name, anchor, end", [
    ("okr_scoreboard_weekly_matrix_early", dt.date(2024, 1, 10), dt.date(2024, 1, 20)),
    ("okr_scoreboard_weekly_matrix_incremental", dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
])
def test_weeks_of_large_orders(spark, large_orders, name, anchor, end):
    sold: dict[str, int] = {}
    for key in range(900):
        day = DAY0 + dt.timedelta(days=key % 30)
        if key % 10 and anchor <= day < end:
            week = (anchor + dt.timedelta(days=(day - anchor).days // 7 * 7)).isoformat()
            sold[week] = sold.get(week, 0) + 1
    assert max(sold.values()) * CENTS >= 10 ** 12  # more than decimal(12,2) holds
    got = {r["indicator"]: r.asDict() for r in queries()[name](spark, large_orders).collect()}
    assert len(got) == 27
    assert {w: x for w, x in got["01 sales"].items() if w in sold} == {w: n * CENTS / 100 for w, n in sold.items()}
    assert {w: x for w, x in got["04 package orders"].items() if w in sold} == sold
