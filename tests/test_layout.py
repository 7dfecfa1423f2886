"""Joins without a shuffle, the semi join of M05, and one scan for orders and first orders: plans and results."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import growth, segments
from kpiloom.operators.scoreboard import Grain, scoreboard_base
from kpiloom.params import FIXTURE
from kpiloom.plans.layout import customers_of_periods, read_layout, write_layout
from kpiloom.sources.tables import derive_test_tables

from .conftest import SF_SMALL
from .test_plans import plan

RANGE = FIXTURE.with_(date_from=dt.date(2024, 1, 8), date_to=dt.date(2024, 1, 22))


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    t = derive_test_tables(spark, SF_SMALL)
    name = f"layout_{uuid.uuid4().hex}"
    write_layout(t, name, str(tmp_path_factory.mktemp("layout")), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield t, read_layout(spark, t, name)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


def below_join(p):
    """The part of a plan under its (only) join."""
    joins = [i for i, ln in enumerate(p.splitlines()) if "Join" in ln]
    assert joins
    return "\n".join(p.splitlines()[joins[0]:])


@pytest.mark.parametrize("p", [FIXTURE, RANGE])
def test_order_lines_join_without_exchange(laid_out, p):
    t, bucketed = laid_out
    own = growth.growth_washes_per_order(bucketed, p)
    assert "Exchange" not in below_join(final(own)) and "Exchange" in below_join(final(growth.growth_washes_per_order(t, p)))
    assert own.collect() == growth.growth_washes_per_order(t, p).collect()


@pytest.mark.parametrize("weekly", [False, True])
def test_customers_join_without_exchange(laid_out, weekly):
    t, bucketed = laid_out
    own = customers_of_periods(bucketed.client_days, Grain(FIXTURE, weekly))
    assert "Exchange" not in below_join(final(own))
    base = {r["period"]: r for r in scoreboard_base(t, FIXTURE, weekly, False).collect()}
    got = own.collect()
    assert got
    for r in got:
        for c in ("total_orders", "sales_sar", "active_customers", "new_customers", "returning_customers", "aopu"):
            assert r[c] == base[r["period"]][c], c


def test_client_days_bound_a_hot_client(spark):
    """A client has a row a day at most."""
    from kpiloom.plans.layout import client_days

    t = derive_test_tables(spark, SF_SMALL)
    hot = t.replace(reservations=t.reservations.withColumn("client_id", F.lit(1).cast("bigint")))
    rows = client_days(hot).where("client_id = 1")
    assert rows.count() == rows.select("act").distinct().count() <= 60


def test_washes_aggregate_lines_of_filtered_orders_only(spark):
    t = derive_test_tables(spark, SF_SMALL)
    r = growth._orders(t, RANGE).select("id", "created_at")
    ids = {x.id for x in r.collect()}
    lines = [x.reservation_id for x in t.reservation_service.collect()]
    assert growth._lines(t, r, RANGE).count() == sum(i in ids for i in lines) < len(lines)
    p = plan(growth.growth_washes_per_order(t, RANGE))
    # the semi join stands below the aggregate over lines
    assert p.index("keys=[reservation_id") < p.index("LeftSemi")
    assert "LeftSemi" not in plan(growth.growth_washes_per_order(t, FIXTURE))


@pytest.mark.parametrize("op", [growth.growth_repeat, growth.growth_aopu, segments.indiv_new_vs_returning, segments.indiv_repeat_trend])
@pytest.mark.parametrize("grain", ["daily", "cumulative", "monthly"])
def test_orders_and_first_orders_from_one_scan(spark, op, grain):
    t = derive_test_tables(spark, SF_SMALL)
    p = final(op(t, FIXTURE.with_(grain=grain)))
    # where first orders are not asked for, Spark drops their side of the join
    assert p.count("FileScan parquet") == 1 and ("ReusedExchange" in p) == ("Join" in p)
