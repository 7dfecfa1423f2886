"""Growth KPIs (M01-M10): one series per metric at daily, monthly, weekly or cumulative grain.

Shape of every operator: filter the live fact rows (date field filter on the
metric's date column), aggregate to one row per period with partial (map-side)
aggregation, then apply the grain: cumulative = running sums over the per-period
rows (ratio metrics take the ratio of running sums). Windows therefore only ever
see one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import apply_date_filter, bsum, dec, live, period, ratio, rnd, rnd_dec
from kpiloom.functions.windows import running, running_ratio
from kpiloom.params import Params
from kpiloom.sources.tables import Tables


def _period(p: Params, col: str = "created_at") -> Column:
    return period(col, p.effective_grain, p.anchor).alias("period")


def _cum(p: Params) -> bool:
    return p.effective_grain == "cumulative"


def _orders(t: Tables, p: Params) -> DataFrame:
    return apply_date_filter(live(t.reservations), "created_at", p)


def _series(g: DataFrame, p: Params, count_cols: dict[str, str], ratio_cols: dict[str, tuple]) -> DataFrame:
    """Finish a per-period aggregate: counts (running when cumulative) and ratios
    (ratio of running sums when cumulative). ratio_cols: name -> (num, den, scale, digits)."""
    cum = _cum(p)
    out = [F.col("period")]
    for name, src in count_cols.items():
        out.append((running(src) if cum else F.col(src)).alias(name))
    for name, (num, den, scale, digits) in ratio_cols.items():
        if cum:
            r = running_ratio(num, den, scale=scale)
        else:
            r = ratio(F.col(num) * scale if scale != 1 else F.col(num), den)
        out.append(rnd(r, digits).alias(name))
    return g.select(*out).orderBy("period")


def growth_sales(t: Tables, p: Params) -> DataFrame:
    """Sum of order value per period (all statuses)."""
    g = _orders(t, p).groupBy(_period(p)).agg(F.sum(dec("total_price")).alias("n"))
    sales = running("n") if _cum(p) else F.col("n")
    return g.select("period", rnd_dec(sales, 2).alias("sales")).orderBy("period")


def growth_orders(t: Tables, p: Params) -> DataFrame:
    """Order count per period."""
    g = _orders(t, p).groupBy(_period(p)).agg(F.count(F.lit(1)).alias("n"))
    return _series(g, p, {"orders": "n"}, {})


def growth_package_orders(t: Tables, p: Params) -> DataFrame:
    """Orders paid from a package, and their share of all orders."""
    g = _orders(t, p).groupBy(_period(p)).agg(
        bsum(F.col("use_package") == 1).alias("pkg"), F.count(F.lit(1)).alias("tot"))
    return _series(g, p, {"package_orders": "pkg"}, {"package_pct": ("pkg", "tot", 100, 1)})


def growth_single_orders(t: Tables, p: Params) -> DataFrame:
    """Single (non-package) orders and their share."""
    g = _orders(t, p).groupBy(_period(p)).agg(
        bsum(F.col("use_package") == 0).alias("sgl"), F.count(F.lit(1)).alias("tot"))
    return _series(g, p, {"single_orders": "sgl"}, {"single_pct": ("sgl", "tot", 100, 1)})


def _lines(t: Tables, r: DataFrame, p: Params) -> DataFrame:
    """The order lines that M05 aggregates: under a date filter those of its orders ``r``."""
    if p.date_from is None and p.date_to is None:
        return t.reservation_service
    return t.reservation_service.join(r.select(F.col("id").alias("reservation_id")), "reservation_id", "left_semi")


def growth_washes_per_order(t: Tables, p: Params) -> DataFrame:
    """Service lines (not product, not deleted) per order; an order without any line
    counts as one wash. Lines are pre-aggregated per order, so the join has no fan-out
    (reservations.id is the primary key). Under a date filter only the lines of its orders are
    aggregated: a semi join on the order id, whose layout the aggregate and the join then share."""
    r = _orders(t, p).select("id", "created_at")
    lines = _lines(t, r, p).groupBy("reservation_id").agg(
        F.sum(F.when((F.coalesce("is_product", F.lit(0)) == 0) & (F.coalesce("is_deleted", F.lit(0)) == 0), 1)
              .otherwise(0)).alias("w"))
    j = r.join(lines, r["id"] == lines["reservation_id"], "left")
    g = j.groupBy(_period(p)).agg(F.sum(F.coalesce("w", F.lit(1))).alias("washes"),
                                   F.count(F.lit(1)).alias("orders"))
    return _series(g, p, {}, {"washes_per_order": ("washes", "orders", 1, 2)})


def growth_time_to_consume(t: Tables, p: Params) -> DataFrame:
    """Mean days from package purchase to its last use; the date filter binds to
    the purchase time. Last use is a partial MAX per subscription before the join."""
    subs = apply_date_filter(live(t.package_subscriptions), "created_at", p).select(
        F.col("id").alias("sid"), F.col("created_at").alias("sc"))
    last_use = (live(t.reservations).where(F.col("subscription_id").isNotNull())
                .groupBy("subscription_id").agg(F.max("created_at").alias("lu")))
    s = subs.join(last_use, subs["sid"] == last_use["subscription_id"], "inner").where(F.col("lu").isNotNull())
    g = s.groupBy(period("sc", p.effective_grain, p.anchor).alias("period")).agg(
        F.sum(F.datediff("lu", "sc")).alias("sum_days"), F.count(F.lit(1)).alias("cnt"))
    return _series(g, p, {}, {"avg_days_to_consume": ("sum_days", "cnt", 1, 1)})


def growth_aov(t: Tables, p: Params) -> DataFrame:
    """Average order value of single orders (revenue / orders)."""
    g = _orders(t, p).where(F.col("use_package") == 0).groupBy(_period(p)).agg(
        F.sum(dec("total_price")).alias("rev"), F.count(F.lit(1)).alias("orders"))
    return _series(g, p, {}, {"aov": ("rev", "orders", 1, 2)})


def growth_completed(t: Tables, p: Params) -> DataFrame:
    """Completed orders (status 3)."""
    g = _orders(t, p).where(F.col("status") == 3).groupBy(_period(p)).agg(F.count(F.lit(1)).alias("n"))
    return _series(g, p, {"completed": "n"}, {})


def client_periods(r: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """From one scan of (client_id, created_at): per period orders and distinct users, and per period the clients whose
    first order (within the rows) falls into it.

    Both come from one aggregate by (client, period), whose shuffle they share. A client has a row for each of its
    periods at most, and no client is gathered: a client holding a third of all orders costs one row for each
    period and map task. The first period is that of the first order, as periods follow time."""
    # the filter holds for all; it keeps the column, so that both branches read the same exchange
    pairs = r.groupBy("client_id", key.alias("period")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    totals = pairs.groupBy("period").agg(F.sum("n").alias("orders"), F.count("client_id").alias("users"))
    firsts = pairs.groupBy("client_id").agg(F.min("period").alias("period"))
    return totals, firsts.groupBy("period").agg(F.count(F.lit(1)).alias("newu"))


def _with_first_orders(t: Tables, p: Params) -> DataFrame:
    r = _orders(t, p).select("client_id", "created_at")
    totals, firsts = client_periods(r, period("created_at", p.effective_grain, p.anchor))
    return totals.join(firsts, "period", "left")


def growth_repeat(t: Tables, p: Params) -> DataFrame:
    """Orders that are not the client's first in the filtered range, and their share.
    Equal to ROW_NUMBER() OVER (PARTITION BY client ORDER BY created_at) > 1, computed as
    orders - first orders per period."""
    j = _with_first_orders(t, p).withColumn("rep", F.col("orders") - F.coalesce("newu", F.lit(0)))
    return _series(j, p, {"repeat_orders": "rep"}, {"repeat_rate_pct": ("rep", "orders", 100, 1)})


def growth_aopu(t: Tables, p: Params) -> DataFrame:
    """Orders per user; cumulative = running orders / running first-seen users."""
    j = _with_first_orders(t, p)
    v = running_ratio("orders", "newu") if _cum(p) else ratio("orders", "users")
    return j.select("period", rnd(v, 2).alias("aopu")).orderBy("period")


GROWTH = {
    "growth_sales": growth_sales,
    "growth_orders": growth_orders,
    "growth_package_orders": growth_package_orders,
    "growth_single_orders": growth_single_orders,
    "growth_washes_per_order": growth_washes_per_order,
    "growth_time_to_consume": growth_time_to_consume,
    "growth_aov": growth_aov,
    "growth_completed": growth_completed,
    "growth_repeat": growth_repeat,
    "growth_aopu": growth_aopu,
}
