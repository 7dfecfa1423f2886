"""Weeks whose sales have more than ten digits before the point."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiloom.plans.catalog import QUERIES
from kpiloom.sources.tables import SCHEMAS, Tables


def large_sales(spark) -> Tables:
    """150 paid packages of one client, each at the largest price that a package can have."""
    empty = {n: (lambda n=n: spark.createDataFrame([], SCHEMAS[n])) for n in ("reservations", "clients", "attendances")}
    paid = spark.range(150).select(
        "id", F.lit(7).cast("bigint").alias("client_id"), F.lit(1).alias("status"),
        F.lit(dt.datetime(2024, 1, 11, 9)).cast("timestamp").alias("created_at"),
        F.lit("99999999.99").cast("decimal(10,2)").alias("cost"), F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(1).cast("bigint").alias("package_id"))
    return Tables({**empty, "package_subscriptions": lambda: paid})


@pytest.mark.parametrize("name, week", [
    ("okr_scoreboard_weekly_matrix", "2024-01-08"),
    ("okr_scoreboard_weekly_matrix_early", "2024-01-10"),
    ("okr_scoreboard_weekly_matrix_incremental", "2024-01-08"),
])
def test_sales_of_any_size_are_shown(spark, name, week):
    query = QUERIES[name]
    got = {r["indicator"]: r[week] for r in query.op(large_sales(spark), query.params).collect()}
    assert len(got) == 27
    assert got["01 sales"] == 14_999_999_998.5 and got["21 ARPU"] == 14_999_999_998.5
    assert got["19 AOV"] == 99_999_999.99 and got["04 package orders"] == 150.0
