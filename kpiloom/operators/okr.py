"""OKR cards (M11-M25): monthly series, or daily series over a half-open date range.

grain 'monthly' -> column ``month`` (month start); otherwise ``day`` with the
range [date_from, date_to) applied as a sargable timestamp predicate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (apply_date_filter, bsum, day, dec, hours_between, in_range, live,
                                     month_start, pct, ratio, rnd, rnd_dec)
from kpiloom.params import Params
from kpiloom.sources.tables import Tables


def _key(p: Params, col: str = "created_at") -> tuple[Column, str]:
    if p.effective_grain not in ("daily", "monthly"):
        raise ValueError(f"OKR cards are daily or monthly, not {p.effective_grain}")
    if p.effective_grain == "monthly":
        return month_start(col).alias("month"), "month"
    return day(col).alias("day"), "day"


def _series(df: DataFrame, p: Params, *aggs: Column, col: str = "created_at") -> DataFrame:
    k, name = _key(p, col)
    return apply_date_filter(df, col, p).groupBy(k).agg(*aggs).orderBy(name)


def _post(df: DataFrame, p: Params, *cols) -> DataFrame:
    name = "month" if p.effective_grain == "monthly" else "day"
    return df.select(name, *cols).orderBy(name)


def _res(t: Tables) -> DataFrame:
    return live(t.reservations)


def _n() -> Column:
    return F.count(F.lit(1))


def okr_sales(t: Tables, p: Params) -> DataFrame:
    """M11"""
    return _series(_res(t), p, rnd_dec(F.sum(dec("total_price")), 2).alias("sales"))


def okr_orders(t: Tables, p: Params) -> DataFrame:
    """M12"""
    return _series(_res(t), p, _n().alias("orders"))


def okr_package_share(t: Tables, p: Params) -> DataFrame:
    """M13 (target 40%)"""
    flag = F.col("use_package") == 1
    return _series(_res(t), p, bsum(flag).alias("package_orders"), pct(bsum(flag), _n()).alias("package_pct"))


def okr_single_share(t: Tables, p: Params) -> DataFrame:
    """M14 (target 60%)"""
    flag = F.col("use_package") == 0
    return _series(_res(t), p, bsum(flag).alias("single_orders"), pct(bsum(flag), _n()).alias("single_pct"))


def okr_aov(t: Tables, p: Params) -> DataFrame:
    """AVG(price) of single orders."""
    x = dec("total_price")
    return _series(_res(t).where(F.col("use_package") == 0), p, rnd(ratio(F.sum(x), F.count(x)), 2).alias("aov"))


def okr_completed(t: Tables, p: Params) -> DataFrame:
    """M16"""
    return _series(_res(t).where(F.col("status") == 3), p, _n().alias("completed"))


def okr_new_companies(t: Tables, p: Params) -> DataFrame:
    """M17 (no soft-delete filter on companies)."""
    return _series(t.companies, p, _n().alias("new_companies"))


def okr_leads(t: Tables, p: Params) -> DataFrame:
    """Leads and contacted leads."""
    return _series(t.corporate_wash_leads, p, _n().alias("leads"), bsum(F.col("contact_status") > 0).alias("contacted"))


def _completed_by_workers(t: Tables) -> DataFrame:
    return _res(t).where((F.col("status") == 3) & F.col("representative_id").isNotNull())


def okr_per_washer_per_day(t: Tables, p: Params) -> DataFrame:
    """Completed / (distinct workers x distinct active days) per month."""
    q = p.with_(grain="monthly")
    # (month, worker, day) pre-aggregate first: the two DISTINCT counts then expand
    # per-group rows instead of every fact row
    k, _ = _key(q)
    r = apply_date_filter(_completed_by_workers(t), "created_at", q)
    pre = r.groupBy(k, "representative_id", day("created_at").alias("d")).agg(_n().alias("n"))
    g = pre.groupBy("month").agg(F.sum("n").alias("completed"), F.countDistinct("representative_id").alias("reps"),
                                 F.countDistinct("d").alias("days"))
    return _post(g, q, rnd(ratio("completed", F.col("reps") * F.col("days")), 2).alias("per_washer_per_day"))


def okr_per_washer_daily(t: Tables, p: Params) -> DataFrame:
    """Completed / distinct workers per day."""
    q = p.with_(grain="daily")
    g = _series(_completed_by_workers(t), q, _n().alias("completed"), F.countDistinct("representative_id").alias("reps"))
    return _post(g, q, rnd(ratio("completed", "reps"), 2).alias("per_washer"))


def okr_completed_from_packages(t: Tables, p: Params) -> DataFrame:
    """M21"""
    return _series(_res(t).where((F.col("status") == 3) & (F.col("use_package") == 1)), p,
                   _n().alias("completed_from_packages"))


def okr_csat(t: Tables, p: Params) -> DataFrame:
    """Average score and % of scores >= 4."""
    return _series(live(t.reviews), p, rnd(ratio(F.sum("score"), F.count("score")), 2).alias("avg_score"),
                   pct(bsum(F.col("score") >= 4), _n()).alias("csat_pct"))


def okr_complaint_resolution_hours(t: Tables, p: Params) -> DataFrame:
    """Mean whole hours from complaint to answer (answered complaints only)."""
    h = hours_between("created_at", "answer_at")
    return _series(live(t.client_complaints).where(F.col("answer_at").isNotNull()), p,
                   rnd(ratio(F.sum(h), F.count(h)), 1).alias("avg_hours"))


def okr_complaints(t: Tables, p: Params) -> DataFrame:
    """M24"""
    return _series(live(t.client_complaints), p, _n().alias("issues"))


def sales_last_n_days(t: Tables, p: Params) -> DataFrame:
    """Daily sales over the trailing window created_at >= as_of - n days (no upper bound)."""
    n = p.last_days if p.last_days is not None else 30
    lo = p.today - dt.timedelta(days=n)
    r = _res(t).where(in_range("created_at", lo, None))
    return (r.groupBy(day("created_at").alias("day"))
            .agg(rnd_dec(F.sum(dec("total_price")), 2).alias("sales")).orderBy("day"))


OKR = {
    "okr_sales": okr_sales,
    "okr_orders": okr_orders,
    "okr_package_share": okr_package_share,
    "okr_single_share": okr_single_share,
    "okr_aov": okr_aov,
    "okr_completed": okr_completed,
    "okr_new_companies": okr_new_companies,
    "okr_leads": okr_leads,
    "okr_per_washer_per_day": okr_per_washer_per_day,
    "okr_per_washer_daily": okr_per_washer_daily,
    "okr_completed_from_packages": okr_completed_from_packages,
    "okr_csat": okr_csat,
    "okr_complaint_resolution_hours": okr_complaint_resolution_hours,
    "okr_complaints": okr_complaints,
    "sales_last_n_days": sales_last_n_days,
}
