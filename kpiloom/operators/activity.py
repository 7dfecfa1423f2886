"""Rows behind first activity (S02), stated once for the scoreboard, the full rebuild and the increment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import day_str, live
from kpiloom.sources.tables import Tables


def reservation_activity(t: Tables) -> DataFrame:
    """(client_id, act) of completed single orders, by service day (text)."""
    done = live(t.reservations).where(
        (F.col("status") == 3) & (F.col("use_package") == 0) & F.col("date").isNotNull() & (F.col("date") != ""))
    return done.select("client_id", F.col("date").alias("act"))


def package_activity(t: Tables) -> DataFrame:
    """(client_id, act) of paid packages, by day of purchase (text)."""
    paid = live(t.package_subscriptions).where(F.col("status") == 1)
    return paid.select("client_id", day_str("created_at").alias("act"))


def first_activity_rows(t: Tables) -> DataFrame:
    """(client_id, act) rows whose minimum per client is its first activity."""
    return reservation_activity(t).unionByName(package_activity(t))
