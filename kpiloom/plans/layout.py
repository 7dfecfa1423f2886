"""Tables laid out for joins without a shuffle.

Two joins of the reports have facts on both sides: order lines with orders (M05), and the clients of a period with
their first activity (S05 with S02). Written in buckets of the join key, both sides are read in the layout that the
join needs, so only rows of periods are shuffled.

- ``reservations`` in buckets of ``id`` and ``reservation_service`` in buckets of ``reservation_id``: both keys are
  spread evenly, as an order has a few lines.
- ``client_days`` in buckets of ``client_id``: order units by client and day instead of facts, so a client with a
  third of all orders has no more rows than there are days.

Writing costs one shuffle of each table; every later report saves its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.exprs import day_str, dec, live, rnd, ratio, to_dbl
from kpiloom.functions.windows import min_day_text
from kpiloom.operators.scoreboard import Grain
from kpiloom.params import Params
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables

#: Table -> key of its buckets.
LAYOUT = {"reservations": "id", "reservation_service": "reservation_id", "client_days": "client_id"}
BUCKETS = 8


def client_days(t: Tables) -> DataFrame:
    """(client_id, act, n_single, n_pkg, amount): order units of all time by client and day (text): completed single
    orders by service day, paid packages by day of purchase (S03)."""
    orders = live(t.reservations).where(
        (F.col("status") == 3) & (F.col("use_package") == 0) & F.col("date").isNotNull() & (F.col("date") != ""))
    packages = live(t.package_subscriptions).where(F.col("status") == 1)
    rows = orders.select("client_id", F.col("date").alias("act"), F.lit(1).alias("single"), F.lit(0).alias("pkg"),
                         dec("total_price", 10, 2).alias("amount")).unionByName(
        packages.select("client_id", day_str("created_at").alias("act"), F.lit(0).alias("single"), F.lit(1).alias("pkg"),
                        F.col("cost").cast("decimal(10,2)").alias("amount")))
    return rows.groupBy("client_id", "act").agg(
        F.sum("single").alias("n_single"), F.sum("pkg").alias("n_pkg"), F.sum("amount").alias("amount"))


def write_layout(t: Tables, prefix: str, root: str, *, buckets: int = BUCKETS, tables: tuple[str, ...] = tuple(LAYOUT)) -> None:
    """Write ``tables`` in buckets, one file each, as tables ``prefix_<name>`` with files under ``root``. A large fact
    table wants some thousand buckets; tables that are joined need the same number."""
    for name in tables:
        key = LAYOUT[name]
        rows = client_days(t) if name == "client_days" else t[name]
        (rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .option("path", f"{root.rstrip('/')}/{name}").saveAsTable(f"{prefix}_{name}"))


def read_layout(spark: SparkSession, t: Tables, prefix: str, tables: tuple[str, ...] = tuple(LAYOUT)) -> Tables:
    """``t`` with the bucketed tables in place of its own."""
    return t.replace(**{name: spark.table(f"{prefix}_{name}") for name in tables})


def customers_of_periods(days: DataFrame, g: Grain) -> DataFrame:
    """S02, S05 and S06 from ``client_days``: orders, sales and active, new and returning customers of each period. With
    the table in buckets of ``client_id`` neither side of the join is shuffled."""
    first = min_day_text(days.select("client_id", "act"), "client_id", "act", "fa").where(F.col("client_id").isNotNull())
    units = days.where(g.text_in_range("act")).groupBy("client_id", g.key_text("act").alias("period")).agg(
        F.sum(F.col("n_single") + F.col("n_pkg")).alias("orders"), F.sum("amount").alias("amount"))
    new = g.key_text(F.col("fa")) == F.col("period")
    both = units.join(first, "client_id", "left")
    return both.groupBy("period").agg(
        F.sum("orders").alias("total_orders"), to_dbl(F.coalesce(F.sum("amount"), F.lit(0))).alias("sales_sar"),
        F.count("fa").alias("active_customers"), F.count(F.when(new, 1)).alias("new_customers"),
        F.count(F.when(~new, 1)).alias("returning_customers")).select(
        "*", rnd(ratio("total_orders", "active_customers"), 2).alias("aopu"))


def _with_layout(t: Tables, tables: tuple[str, ...]) -> Tables:
    spark = t.reservations.sparkSession
    name = f"kpiloom_{uuid.uuid4().hex}"
    write_layout(t, name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}", tables=tables)
    return read_layout(spark, t, name, tables)


def washes_per_order_bucketed(t: Tables, p: Params) -> DataFrame:
    """M05 over orders and lines in buckets of the order."""
    from kpiloom.operators.growth import growth_washes_per_order

    return growth_washes_per_order(_with_layout(t, ("reservations", "reservation_service")), p)


def customers_daily_bucketed(t: Tables, p: Params) -> DataFrame:
    """Month-to-date customers by day, from ``client_days`` in buckets of the client."""
    return customers_of_periods(_with_layout(t, ("client_days",)).client_days, Grain(p, False)).orderBy("period")


def customers_weekly_bucketed(t: Tables, p: Params) -> DataFrame:
    """Customers by anchored week, from ``client_days`` in buckets of the client."""
    return customers_of_periods(_with_layout(t, ("client_days",)).client_days, Grain(p, True)).orderBy("period")


BUCKETED = {f.__name__: f for f in (washes_per_order_bucketed, customers_daily_bucketed, customers_weekly_bucketed)}
