"""First activity by increments, and the scoreboards that read it instead of all history.

The test tables are one state of the sources. ``earlier_state`` derives the state before a batch of late changes
from them; the store is built from it and then carried to the present state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.activity import first_activity_rows
from kpiloom.operators.scoreboard import SCOREBOARD
from kpiloom.params import Params
from kpiloom.plans.activity_store import ActivityStore
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables


def earlier_state(t: Tables) -> Tables:
    """Before the changes: nothing was deleted, every fifth order was not there, of the others every seventh was not
    completed and every eleventh was planned for the day before; every third package was not paid."""
    day = F.date_format(F.date_sub(F.try_to_date("date"), 1), "yyyy-MM-dd")
    orders = t.reservations.where("id % 5 <> 0").select(
        *[c for c in t.reservations.columns if c not in ("status", "date", "deleted_at")],
        F.when(F.col("id") % 7 == 0, F.lit(1)).otherwise(F.col("status")).alias("status"),
        F.when(F.col("id") % 11 == 0, F.coalesce(day, "date")).otherwise(F.col("date")).alias("date"),
        F.lit(None).cast("timestamp").alias("deleted_at"))
    packages = t.package_subscriptions.withColumn(
        "status", F.when(F.col("id") % 3 == 0, F.lit(2)).otherwise(F.col("status"))).withColumn(
        "deleted_at", F.lit(None).cast("timestamp"))
    return t.replace(reservations=orders, package_subscriptions=packages)


def incremental_store(t: Tables) -> ActivityStore:
    """A new store, built from the earlier state and carried to the present one."""
    spark = t.reservations.sparkSession
    store = ActivityStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiloom-activity-{uuid.uuid4().hex}")
    before = earlier_state(t)
    store.rebuild(first_activity_rows(before))
    store.refresh(before, t)
    return store


def first_activity_incremental(t: Tables, p: Params) -> DataFrame:
    """S02 by increment: client_id, fa."""
    return incremental_store(t).table().orderBy("client_id")


def _from_store(op: Callable[[Tables, Params], DataFrame]) -> Callable[[Tables, Params], DataFrame]:
    def run(t: Tables, p: Params) -> DataFrame:
        return op(t.replace(first_activity=incremental_store(t).table()), p)

    return run


#: M55 to M58 without the scan of all history.
FROM_STORE = {f"{name}_incremental": _from_store(op) for name, op in SCOREBOARD.items()}
