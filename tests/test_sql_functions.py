"""SQL table functions: defaults, odd prices, and that filters reach the scans."""

import datetime as dt

from pyspark.sql import functions as F

from kpiloom.operators import growth, segments
from kpiloom.params import FIXTURE
from kpiloom.plans.sql_functions import ACCOUNTS, GROWTH, call, install
from kpiloom.sources.tables import derive_test_tables

from .conftest import SF_SMALL
from .test_plans import formatted


def test_defaults_and_named_arguments(spark):
    t = derive_test_tables(spark, SF_SMALL)
    install(spark, t, FIXTURE)
    assert spark.sql("SELECT * FROM growth_orders() ORDER BY period").collect() == growth.growth_orders(t, FIXTURE).collect()
    p = FIXTURE.with_(grain="weekly", date_from=dt.date(2024, 1, 9))
    own = spark.sql("SELECT * FROM growth_aopu('weekly', date_from => TIMESTAMP '2024-01-09') ORDER BY period")
    assert own.collect() == growth.growth_aopu(t, p).collect()
    # an unknown grain is daily
    assert spark.sql("SELECT * FROM growth_orders('hourly') ORDER BY period").collect() == growth.growth_orders(t, FIXTURE).collect()
    assert spark.sql("SELECT washes FROM b2b_washes(account => 'nobody')").first()[0] == 0


def test_every_function_has_the_columns_and_types_of_its_report(spark):
    t = derive_test_tables(spark, SF_SMALL)
    reports = {**growth.GROWTH, **segments.SEGMENTS}
    for name in (*GROWTH, *ACCOUNTS):
        got, own = call(name)(t, FIXTURE), reports[name](t, FIXTURE)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in own.schema], name


def test_odd_prices_equal_the_reports(spark):
    t = derive_test_tables(spark, SF_SMALL)
    odd = ["12.5abc", "", "junk", None, " 7", "1e3", "-99999999999999", "99999999999999.5", "+3.455"]
    price = F.element_at(F.array(*[F.lit(x) for x in odd]), (F.col("id") % len(odd) + 1).cast("int"))
    t = t.replace(reservations=t.reservations.withColumn("total_price", price))
    assert call("growth_sales")(t, FIXTURE).collect() == growth.growth_sales(t, FIXTURE).collect()
    assert call("b2b_account_table")(t, FIXTURE).collect() == segments.b2b_account_table(t, FIXTURE).collect()


def test_arguments_are_pushed_down_and_columns_pruned(spark):
    t = derive_test_tables(spark, SF_SMALL)
    install(spark, t, FIXTURE)
    f = formatted(spark.sql("SELECT * FROM growth_orders('daily', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-09')"))
    assert "GreaterThanOrEqual(ts," in f and "LessThan(ts," in f
    schemas = [ln for ln in f.splitlines() if ln.startswith("ReadSchema")]
    assert schemas and all("value" not in s and "user_id" not in s for s in schemas)
    f = formatted(spark.sql("SELECT * FROM b2b_washes('Customer#000000007')"))
    assert "EqualTo(c_name,Customer#000000007)" in f
