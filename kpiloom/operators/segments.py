"""Customer-segment analytics: B2B accounts (M26-M34), individual customers
and the daily segment split (M47-M49).

The segment is a curated id list (``Params.b2b_ids``). B2B rows are selected with
an IN-list that Parquet can push down; the account names come from ``clients``
filtered to that list; the planner broadcasts them if their measured size allows.
Individuals are the complement (``NOT IN``, so a NULL client is in neither segment).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (bsum, day, dec, in_range, json_text, live, month_start, pct, ratio, rnd,
                                     rnd_dec)
from kpiloom.operators.growth import client_periods
from kpiloom.params import Params
from kpiloom.sources.tables import Tables

# Order-count buckets of the histogram (label, upper bound, rank).
HISTOGRAM_BUCKETS = [("1 (once)", 1, 1), ("2", 2, 2), ("3-5", 5, 3), ("6-10", 10, 4), ("11+", None, 5)]


def _n() -> Column:
    return F.count(F.lit(1))


def _b2b_flag(p: Params) -> Column:
    return F.col("client_id").isin(list(p.b2b_ids))


def _segment_table(t: Tables) -> DataFrame | None:
    """Optional ``b2b_accounts`` table (column ``id``): the segment as data instead of a
    literal list, for segments too large to inline in the plan. Its size is not bounded
    by the query, so joins with it are left to AQE (no broadcast hint)."""
    if "b2b_accounts" not in t.names():
        return None
    return t.b2b_accounts.select(F.col("id").alias("seg_id")).distinct()


def in_segment(df: DataFrame, t: Tables, p: Params, negate: bool = False) -> DataFrame:
    """``client_id IN segment`` / ``NOT IN``: a literal IN-list (pushed to Parquet) or a
    semi / anti join with the segment table. A NULL client is in neither side."""
    seg = _segment_table(t)
    if seg is None:
        return df.where(~_b2b_flag(p) if negate else _b2b_flag(p))
    kind = "left_anti" if negate else "left_semi"
    return df.where(F.col("client_id").isNotNull()).join(seg, F.col("client_id") == F.col("seg_id"), kind)


def with_segment_flag(df: DataFrame, t: Tables, p: Params) -> DataFrame:
    """Adds ``is_b2b`` with IN semantics: TRUE / FALSE, NULL for a NULL client."""
    seg = _segment_table(t)
    if seg is None:
        return df.withColumn("is_b2b", _b2b_flag(p))
    j = df.join(seg, F.col("client_id") == F.col("seg_id"), "left")
    return j.withColumn("is_b2b", F.when(F.col("client_id").isNotNull(), F.col("seg_id").isNotNull())).drop("seg_id")


def b2b_rows(t: Tables, p: Params) -> DataFrame:
    """reservations JOIN clients restricted to the B2B segment and the optional account."""
    seg = _segment_table(t)
    if seg is not None:
        cl = t.clients.join(seg, F.col("id") == F.col("seg_id"), "left_semi")
        name = F.collate(F.col("username"), "UTF8_LCASE") if p.ci_text else F.col("username")
        if p.account is not None:
            cl = cl.where(name == F.lit(p.account))
        cl = cl.select(F.col("id").alias("cid"), name.alias("username"))
        r = in_segment(live(t.reservations), t, p)
        return r.join(cl, r["client_id"] == cl["cid"], "inner").drop("cid")
    ids = list(p.b2b_ids)
    cl = t.clients.where(F.col("id").isin(ids))
    name = F.collate(F.col("username"), "UTF8_LCASE") if p.ci_text else F.col("username")
    if p.account is not None:
        cl = cl.where(name == F.lit(p.account))
    cl = cl.select(F.col("id").alias("cid"), name.alias("username"))
    r = live(t.reservations).where(F.col("client_id").isin(ids))
    return r.join(cl, r["client_id"] == cl["cid"], "inner").drop("cid")


def indiv_rows(t: Tables, p: Params) -> DataFrame:
    return in_segment(live(t.reservations), t, p, negate=True)


def _aov1() -> Column:
    x = F.when(F.col("use_package") == 0, dec("total_price"))
    return rnd(ratio(F.sum(x), F.count(x)), 1)


def _revenue0() -> Column:
    return rnd_dec(F.sum(dec("total_price")), 0)


def _completion() -> Column:
    return pct(bsum(F.col("status") == 3), _n())


# ---- B2B --------------------------------------------------------------------------------
def b2b_washes(t: Tables, p: Params) -> DataFrame:
    """M26"""
    return b2b_rows(t, p).agg(_n().alias("washes"))


def b2b_revenue(t: Tables, p: Params) -> DataFrame:
    """M27"""
    return b2b_rows(t, p).agg(_revenue0().alias("revenue"))


def b2b_aov(t: Tables, p: Params) -> DataFrame:
    """M28"""
    return b2b_rows(t, p).agg(_aov1().alias("aov"))


def b2b_active_accounts(t: Tables, p: Params) -> DataFrame:
    """M29"""
    return b2b_rows(t, p).agg(F.countDistinct("client_id").alias("accounts"))


def b2b_completion_pct(t: Tables, p: Params) -> DataFrame:
    """M30"""
    return b2b_rows(t, p).agg(_completion().alias("completion_pct"))


def b2b_account_table(t: Tables, p: Params) -> DataFrame:
    """One row per account, most washes first."""
    return (b2b_rows(t, p).groupBy(F.col("username").alias("account"))
            .agg(_n().alias("washes"), _revenue0().alias("revenue"), _aov1().alias("aov"),
                 bsum(F.col("use_package") == 1).alias("package_washes"), _completion().alias("completion_pct"),
                 F.min(day("created_at")).alias("first_order"), F.max(day("created_at")).alias("last_order"))
            .orderBy(F.desc("washes"), F.asc("account")))


def _monthly_split(df: DataFrame) -> DataFrame:
    return (df.groupBy(month_start("created_at").alias("month"))
            .agg(bsum(F.col("use_package") == 0).alias("single"), bsum(F.col("use_package") == 1).alias("package"))
            .orderBy("month"))


def _monthly_revenue(df: DataFrame) -> DataFrame:
    return df.groupBy(month_start("created_at").alias("month")).agg(_revenue0().alias("revenue")).orderBy("month")


def b2b_monthly_washes(t: Tables, p: Params) -> DataFrame:
    """M32"""
    return _monthly_split(b2b_rows(t, p))


def b2b_monthly_revenue(t: Tables, p: Params) -> DataFrame:
    """M33"""
    return _monthly_revenue(b2b_rows(t, p))


def _by_city(t: Tables, rows: DataFrame) -> DataFrame:
    """Count per city_id first (tiny), then attach the localized name and merge equal names."""
    per_id = rows.groupBy("city_id").agg(_n().alias("n"))
    cities = t.cities.select(F.col("id").alias("cid"), json_text("name", "$.ar").alias("city"))
    j = per_id.join(cities, per_id["city_id"] == cities["cid"], "left")
    return j.groupBy("city").agg(F.sum("n").alias("washes"))


def b2b_washes_by_city(t: Tables, p: Params) -> DataFrame:
    """M34"""
    return _by_city(t, b2b_rows(t, p)).orderBy(F.desc("washes"), F.asc_nulls_last("city"))


# ---- individuals -------------------------------------------------------------------------
def indiv_customers(t: Tables, p: Params) -> DataFrame:
    """M35"""
    return indiv_rows(t, p).agg(F.countDistinct("client_id").alias("customers"))


def indiv_washes(t: Tables, p: Params) -> DataFrame:
    """M36"""
    return indiv_rows(t, p).agg(_n().alias("washes"))


def indiv_revenue(t: Tables, p: Params) -> DataFrame:
    """M37"""
    return indiv_rows(t, p).agg(_revenue0().alias("revenue"))


def indiv_aov(t: Tables, p: Params) -> DataFrame:
    """M38"""
    return indiv_rows(t, p).agg(_aov1().alias("aov"))


def indiv_repeat_rate(t: Tables, p: Params) -> DataFrame:
    """Share of orders that are not the client's first. ROW_NUMBER() > 1 counts
    orders - clients, so no client-partitioned window is needed."""
    return indiv_rows(t, p).agg(pct(_n() - F.countDistinct("client_id"), _n()).alias("repeat_rate_pct"))


def indiv_aopu(t: Tables, p: Params) -> DataFrame:
    """M40"""
    return indiv_rows(t, p).agg(rnd(ratio(_n(), F.countDistinct("client_id")), 2).alias("aopu"))


def indiv_monthly_washes(t: Tables, p: Params) -> DataFrame:
    """M41"""
    return _monthly_split(indiv_rows(t, p))


def indiv_monthly_revenue(t: Tables, p: Params) -> DataFrame:
    """M42"""
    return _monthly_revenue(indiv_rows(t, p))


def indiv_new_vs_returning(t: Tables, p: Params) -> DataFrame:
    """Per month, distinct clients whose first-ever month is / is not this month: active clients, and those of
    them whose first month it is, from one scan."""
    totals, firsts = client_periods(indiv_rows(t, p), month_start("created_at"))
    new = F.coalesce("newu", F.lit(0))
    return totals.join(firsts, "period", "left").select(
        F.col("period").alias("month"), new.alias("new_customers"), (F.col("users") - new).alias("returning_customers")).orderBy("month")


def indiv_repeat_trend(t: Tables, p: Params) -> DataFrame:
    """Monthly % of orders that are not the client's first (all-time order)."""
    totals, firsts = client_periods(indiv_rows(t, p), month_start("created_at"))
    repeated = F.col("orders") - F.coalesce("newu", F.lit(0))
    return totals.join(firsts, "period", "left").select(
        F.col("period").alias("month"), pct(repeated, "orders").alias("repeat_rate_pct")).orderBy("month")


def indiv_order_histogram(t: Tables, p: Params) -> DataFrame:
    """Clients bucketed by their number of orders, in bucket order."""
    per_client = indiv_rows(t, p).groupBy("client_id").agg(_n().alias("cnt"))
    label, rank = None, None
    for name, upper, r in reversed(HISTOGRAM_BUCKETS):
        if upper is None:
            label, rank = F.lit(name), F.lit(r)
        else:
            cond = F.col("cnt") <= upper
            label, rank = F.when(cond, name).otherwise(label), F.when(cond, r).otherwise(rank)
    g = per_client.groupBy(label.alias("bucket"), rank.alias("ord")).agg(_n().alias("customers"))
    return g.orderBy("ord").select("bucket", "customers")


def indiv_top_cities(t: Tables, p: Params, k: int = 10) -> DataFrame:
    """Top 10 cities by washes (ties broken by name so the cut is deterministic)."""
    return _by_city(t, indiv_rows(t, p)).orderBy(F.desc("washes"), F.asc_nulls_last("city")).limit(k)


# ---- daily segment split -------------------------------------------------------------------
def _since(df: DataFrame, p: Params, days: int | None) -> DataFrame:
    if days is None:
        return df
    return df.where(in_range("created_at", p.today - dt.timedelta(days=days), None))


def daily_segment_orders(t: Tables, p: Params) -> DataFrame:
    """M47"""
    r = with_segment_flag(live(t.reservations), t, p)
    b2b = F.col("is_b2b")
    return (r.groupBy(day("created_at").alias("day"))
            .agg(bsum(~b2b).alias("individual_orders"), bsum(b2b).alias("b2b_orders"))
            .orderBy("day"))


def daily_segment_table(t: Tables, p: Params) -> DataFrame:
    """Last 60 days, newest first."""
    r = with_segment_flag(_since(live(t.reservations), p, 60 if p.last_days is None else p.last_days), t, p)
    b2b = F.col("is_b2b")
    return (r.groupBy(day("created_at").alias("day"))
            .agg(bsum(~b2b).alias("individual_orders"), bsum(b2b).alias("b2b_orders"),
                 _n().alias("total_orders"))
            .orderBy(F.desc("day")))


def daily_completed_by_segment(t: Tables, p: Params) -> DataFrame:
    """Completed washes per day by segment plus all orders, last 90 days."""
    r = with_segment_flag(_since(live(t.reservations), p, 90 if p.last_days is None else p.last_days), t, p)
    done, b2b = F.col("status") == 3, F.col("is_b2b")
    return (r.groupBy(day("created_at").alias("day"))
            .agg(bsum(done & b2b).alias("b2b_completed"), bsum(done & ~b2b).alias("individual_completed"),
                 bsum(done).alias("total_completed"), _n().alias("total_orders"))
            .orderBy(F.desc("day")))


SEGMENTS = {f.__name__: f for f in (
    b2b_washes, b2b_revenue, b2b_aov, b2b_active_accounts, b2b_completion_pct, b2b_account_table,
    b2b_monthly_washes, b2b_monthly_revenue, b2b_washes_by_city,
    indiv_customers, indiv_washes, indiv_revenue, indiv_aov, indiv_repeat_rate, indiv_aopu,
    indiv_monthly_washes, indiv_monthly_revenue, indiv_new_vs_returning, indiv_repeat_trend,
    indiv_order_histogram, indiv_top_cities,
    daily_segment_orders, daily_segment_table, daily_completed_by_segment)}
