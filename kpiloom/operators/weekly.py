"""Weekly KPIs (M59-M65) and the daily purchase breakdown.

Weeks are 7-day buckets anchored at ``Params.anchor`` (a true floor, see
``week_start``). Ranges that end "before today" use ``Params.today``; the
source reports without an upper bound (M61, M62) keep none.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (bsum, day_str, in_range, live, month_start, ratio, rnd, week_start,
                                     week_str)
from kpiloom.params import Params
from kpiloom.sources.tables import Tables


def _n() -> Column:
    return F.count(F.lit(1))


def _service_day_in(df: DataFrame, lo: dt.date, hi: dt.date | None) -> DataFrame:
    """`date` is text 'YYYY-MM-DD': compared as text, NULL and '' never match."""
    cond = F.col("date").isNotNull() & (F.col("date") != "") & (F.col("date") >= F.lit(lo.isoformat()))
    if hi is not None:
        cond = cond & (F.col("date") < F.lit(hi.isoformat()))
    return df.where(cond)


def _start(p: Params) -> dt.date:
    return p.date_from or p.anchor


def north_star_weighted(t: Tables, p: Params) -> DataFrame:
    """Sum of daily completed washes / sum of daily present workers, over days
    present in both (weighted, not an average of daily ratios)."""
    lo, hi = _start(p), p.today
    d = (_service_day_in(live(t.reservations).where(F.col("status") == 3), lo, hi)
         .groupBy(F.col("date").alias("day")).agg(_n().alias("washes")))
    a = (t.attendances.where((F.col("date") >= F.lit(lo)) & (F.col("date") < F.lit(hi)))
         .groupBy(day_str("date").alias("day")).agg(F.countDistinct("representative_id").alias("washers")))
    j = d.join(a, "day", "inner")
    return j.agg(rnd(ratio(F.sum("washes"), F.sum("washers")), 2).alias("washes_per_washer_daily"))


def north_star_per_week(t: Tables, p: Params) -> DataFrame:
    """Completed washes per week / distinct workers present in the week."""
    lo, hi = p.anchor, p.today
    w = (_service_day_in(live(t.reservations).where(F.col("status") == 3), lo, hi)
         .groupBy(week_start("date", p.anchor).alias("week_start")).agg(_n().alias("washes")))
    a = (t.attendances.where((F.col("date") >= F.lit(lo)) & (F.col("date") < F.lit(hi)))
         .groupBy(week_start("date", p.anchor).alias("week_start"))
         .agg(F.countDistinct("representative_id").alias("washers")))
    j = w.join(a, "week_start", "inner")
    return j.select("week_start", rnd(ratio("washes", "washers"), 2).alias("washes_per_washer_week")).orderBy("week_start")


def weekly_paid_washes(t: Tables, p: Params) -> DataFrame:
    """Single / package / total washes per week since the anchor (no upper bound)."""
    r = live(t.reservations).where(in_range("created_at", p.anchor))
    return (r.groupBy(week_start("created_at", p.anchor).alias("week_start"))
            .agg(bsum(F.col("use_package") == 0).alias("single_washes"),
                 bsum(F.col("use_package") == 1).alias("package_washes"), _n().alias("total_paid_washes"))
            .orderBy("week_start"))


def _package_breakdown(t: Tables, p: Params, key_fn, lo: dt.date, hi: dt.date | None) -> DataFrame:
    """Paid package purchases per period: customised / not customised (NULL counts as not) /
    in the offer list. Purchases are counted per (period, package) before the join with
    ``packages``, so the join sees at most one row per package and period."""
    ps = live(t.package_subscriptions).where((F.col("status") == 1) & in_range("created_at", lo, hi))
    per_pkg = ps.groupBy(key_fn("created_at").alias("k"), "package_id").agg(_n().alias("n"))
    pk = t.packages.select(F.col("id").alias("pid"), "is_customized")
    j = per_pkg.join(pk, per_pkg["package_id"] == pk["pid"], "inner")

    def wsum(cond: Column) -> Column:  # SUM(cond) over the original rows, NULL-preserving
        return F.sum(F.when(cond, F.col("n")).when(~cond, F.lit(0)))

    return j.groupBy("k").agg(
        wsum(F.col("is_customized") == 1).alias("pkg_customized"),
        wsum(F.coalesce("is_customized", F.lit(0)) == 0).alias("pkg_non_customized"),
        wsum(F.col("package_id").isin(list(p.offer_package_ids))).alias("bogo_free_wash"))


def weekly_purchase_breakdown(t: Tables, p: Params) -> DataFrame:
    """Weeks with any reservation since the anchor; single purchases and package
    purchases (customised / not / offer) per week. No upper bound."""
    wk = lambda col: week_str(col, p.anchor)
    r = live(t.reservations).where(in_range("created_at", p.anchor))
    # one aggregate gives both the week spine (weeks with any reservation) and single purchases
    sp = r.groupBy(wk("created_at").alias("k")).agg(F.count(F.when(F.col("use_package") == 0, 1)).alias("single_purchased"))
    pk = _package_breakdown(t, p, wk, p.anchor, None)
    j = sp.join(pk, "k", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select(F.col("k").alias("week"), z("single_purchased"), z("pkg_customized"), z("pkg_non_customized"),
                    z("bogo_free_wash")).orderBy(F.desc("week"))


def worker_load(r: DataFrame, key: Column, name: str) -> DataFrame:
    """Assigned / executed jobs and distinct assigned / executing workers per period.
    Counted per (period, worker) first, so the distinct counts are plain counts of groups
    (no Expand of the fact rows for two DISTINCT aggregates)."""
    per_worker = r.groupBy(key, "representative_id").agg(
        _n().alias("n"), bsum(F.col("status") == 3).alias("ex"))
    return per_worker.groupBy(name).agg(
        F.sum("n").alias("assigned"), _n().alias("asg_washers"), F.sum("ex").alias("executed"),
        F.count(F.when(F.col("ex") > 0, 1)).alias("exec_washers"))


def weekly_worker_efficiency(t: Tables, p: Params) -> DataFrame:
    """100 * (executed per executing worker) / (assigned per assigned worker)."""
    r = _service_day_in(live(t.reservations).where(F.col("representative_id").isNotNull()), p.anchor, p.today)
    e = worker_load(r, week_start("date", p.anchor).alias("week"), "week").withColumnRenamed(
        "asg_washers", "asg_w").withColumnRenamed("exec_washers", "exec_w")
    eff = ratio(ratio("executed", "exec_w") * 100, ratio("assigned", "asg_w"))
    return e.select("week", rnd(eff, 1).alias("efficiency_pct")).orderBy("week")


def weekly_assignment_efficiency(t: Tables, p: Params) -> DataFrame:
    """No-slot page visits per order, per week. LEFT JOIN from the visits, so weeks
    with orders but no visits are not reported."""
    wk = lambda col: week_str(col, p.anchor)
    v = (t.user_area_availability_alert_logs.where(in_range("created_at", p.anchor, p.today))
         .groupBy(wk("created_at").alias("wk")).agg(_n().alias("visits")))
    o = (live(t.reservations).where(in_range("created_at", p.anchor, p.today))
         .groupBy(wk("created_at").alias("wk")).agg(_n().alias("orders_")))
    j = v.join(o, "wk", "left")
    return j.select(F.col("wk").cast("date").alias("week"), F.coalesce("visits", F.lit(0)).alias("visits"),
                    F.coalesce("orders_", F.lit(0)).alias("orders"),
                    rnd(ratio("visits", "orders_"), 3).alias("assignment_efficiency")).orderBy("week")


def monthly_paid_washes(t: Tables, p: Params) -> DataFrame:
    """Single and package washes per month (stacked)."""
    return (live(t.reservations).groupBy(month_start("created_at").alias("month"))
            .agg(bsum(F.col("use_package") == 0).alias("single_washes"),
                 bsum(F.col("use_package") == 1).alias("package_washes"))
            .orderBy("month"))


def daily_purchase_breakdown(t: Tables, p: Params) -> DataFrame:
    """By purchase day over the last 60 days before today: single purchases and
    package purchases (customised / not / offer); days with either kind are listed."""
    n = 60 if p.last_days is None else p.last_days
    lo, hi = p.today - dt.timedelta(days=n), p.today
    r = live(t.reservations).where((F.col("use_package") == 0) & in_range("created_at", lo, hi))
    sp = r.groupBy(day_str("created_at").alias("k")).agg(_n().alias("single_purchased"))
    pk = _package_breakdown(t, p, day_str, lo, hi)
    j = sp.join(pk, "k", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select(F.col("k").alias("day"), z("single_purchased"), z("pkg_customized"), z("pkg_non_customized"),
                    z("bogo_free_wash")).orderBy(F.desc("day"))


WEEKLY = {f.__name__: f for f in (
    north_star_weighted, north_star_per_week, weekly_paid_washes, weekly_purchase_breakdown,
    weekly_worker_efficiency, weekly_assignment_efficiency, monthly_paid_washes, daily_purchase_breakdown)}
