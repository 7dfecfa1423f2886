"""The fused board: each card equals its own query, from one scan of each source table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiloom.operators.okr import OKR
from kpiloom.operators.okr_cards import OKR_CARDS
from kpiloom.params import FIXTURE
from kpiloom.plans.board import okr_board, okr_board_long, run_fused
from kpiloom.plans.fused import FusedBoard
from kpiloom.sources.tables import derive_test_tables

from .conftest import SF_SMALL
from .test_plans import plan

PARAMS = {
    "monthly": FIXTURE.with_(grain="monthly"),
    "daily": FIXTURE.with_(grain="daily"),
    "range": FIXTURE.with_(grain="daily", date_from=dt.date(2024, 1, 9), date_to=dt.date(2024, 1, 12)),
    "none": FIXTURE.with_(grain="daily", date_from=dt.date(2030, 1, 9)),
}


def odd(t):
    """NULL flags, prices and scores, and periods in which some cards have no row."""
    r = t.reservations.withColumn("use_package", F.when(F.dayofmonth("created_at") != 9, F.col("use_package")))
    r = r.withColumn("status", F.when(F.dayofmonth("created_at") != 10, F.col("status")).otherwise(6))
    r = r.withColumn("total_price", F.when(F.dayofmonth("created_at") != 11, F.col("total_price")))
    return t.replace(reservations=r, reviews=t.reviews.withColumn("score", F.when(F.dayofmonth("created_at") != 9, F.col("score"))),
                     client_complaints=t.client_complaints.where(F.dayofmonth("created_at") != 10))


@pytest.mark.parametrize("tables", ["plain", "odd"])
@pytest.mark.parametrize("name", PARAMS)
def test_cards_equal_their_own_queries(spark, tmp_path, name, tables):
    p = PARAMS[name]
    t = derive_test_tables(spark, SF_SMALL)
    t = odd(t) if tables == "odd" else t
    fused = run_fused(OKR_CARDS, t, p, str(tmp_path))
    assert set(fused) == {c.name for c in OKR_CARDS if p.effective_grain in c.grains}
    long = {}
    for r in okr_board_long(t, p).collect():
        long.setdefault(r.card, {})[r.period, r.metric] = r.value
    for card, got in fused.items():
        own = OKR[card](t, p)
        assert got.columns == own.columns and [f.dataType for f in got.schema] == [f.dataType for f in own.schema]
        rows = own.collect()
        assert got.collect() == rows, card
        want = {(r[0], m): None if r[m] is None else float(r[m]) for r in rows for m in own.columns[1:]}
        assert long.get(card, {}) == want, card


def test_every_okr_card_is_on_the_board():
    assert {c.name for c in OKR_CARDS} == set(okr_board())


def test_one_scan_of_each_table(spark):
    t = derive_test_tables(spark, SF_SMALL)
    board = FusedBoard(OKR_CARDS, t, PARAMS["monthly"])
    assert len(board.frames) == 5
    for frame in board.frames.values():
        assert plan(frame).count("FileScan parquet") == 1
    long = okr_board_long(t, PARAMS["range"])
    # reservations, reviews and complaints all come from events here; companies and leads from two other files
    assert plan(long).count("FileScan parquet") == 5
    assert "Window" not in plan(long) and "Join" not in plan(long)


def test_distinct_keys_are_counted_over_reduced_rows(spark):
    """Expand, which copies rows for two distinct counts, stands above the first aggregate."""
    t = derive_test_tables(spark, SF_SMALL)
    frame = next(f for k, f in FusedBoard(OKR_CARDS, t, PARAMS["monthly"]).frames.items() if k[0] == "reservations")
    p = plan(frame)
    assert "Expand" in p and p.index("Expand") < p.index("FileScan")
    assert "HashAggregate" in p[p.index("Expand"):]
