"""The growth and account cards as SQL table functions: M01 to M10 and M26 to M34 for callers who write SQL.

    SELECT * FROM growth_orders('weekly', date_from => TIMESTAMP '2024-01-03')
    SELECT * FROM b2b_account_table(account => 'Customer#000000007')

``install`` registers the source tables as temporary views, the accounts of the segment as ``b2b_accounts`` and the
functions. An argument that is NULL or left out is no filter. Functions are inlined by the analyser, so filters and
columns reach the scans as in hand-written SQL. Rows come in no particular order; callers sort.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiloom.functions.exprs import LEADING_NUMBER
from kpiloom.params import Params
from kpiloom.plans.sql_surface import register_views
from kpiloom.sources.tables import Tables

VIEWS = ("reservations", "reservation_service", "package_subscriptions", "clients", "cities")


def _price(x: str) -> str:
    """A text price as the source database reads it: its leading number, clamped to the type; text without one is 0."""
    lead = f"regexp_extract({x}, r'{LEADING_NUMBER}', 1)"
    size = f"try_cast({lead} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast({x} AS DECIMAL(12,2)), try_cast({lead} AS DECIMAL(12,2)), "
            f"CAST(CASE WHEN {size} >= 9999999999.99D THEN 9999999999.99 WHEN {size} <= -9999999999.99D THEN -9999999999.99 "
            f"ELSE 0 END AS DECIMAL(12,2))) END")


def _ratio(a: str, b: str) -> str:
    """A ratio in doubles; NULL where it would divide by zero."""
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0D)"


def _rounded(x: str, digits: int) -> str:
    """Rounded from a decimal, so that the last bits of a double do not matter."""
    return f"CAST(round(CAST({x} AS DECIMAL(18,6)), {digits}) AS DOUBLE)"


def _period(column: str) -> str:
    return (f"CASE grain WHEN 'monthly' THEN trunc({column}, 'MM') "
            f"WHEN 'weekly' THEN date_add(anchor, CAST(floor(datediff(to_date({column}), anchor) / 7) * 7 AS INT)) "
            f"ELSE to_date({column}) END")


def _dated(column: str) -> str:
    return f"(date_from IS NULL OR {column} >= date_from) AND (date_to IS NULL OR {column} < date_to)"


def _total(x: str) -> str:
    """A count or sum of a period, or up to it."""
    return f"CASE WHEN grain = 'cumulative' THEN SUM({x}) OVER (ORDER BY period) ELSE {x} END"


def _share(a: str, b: str, digits: int, scale: int = 1) -> str:
    """A ratio of totals of a period, or up to it."""
    return _rounded(_ratio(f"({scale} * ({_total(a)}))", f"({_total(b)})"), digits)


_ORDERS = f"SELECT *, {_period('created_at')} AS period FROM reservations WHERE deleted_at IS NULL AND {_dated('created_at')}"
_FIRSTS = f"""pairs AS (SELECT client_id, period, count(*) AS n FROM ({_ORDERS}) GROUP BY client_id, period),
totals AS (SELECT period, sum(n) AS orders, count(client_id) AS users FROM pairs GROUP BY period),
firsts AS (SELECT period, count(*) AS newu FROM (SELECT client_id, min(period) AS period FROM pairs GROUP BY client_id) GROUP BY period),
g AS (SELECT t.period, orders, users, coalesce(newu, 0) AS newu FROM totals t LEFT JOIN firsts f ON t.period = f.period)"""

#: Name -> (result columns, query). All take (grain, date_from, date_to, anchor).
GROWTH = {
    "growth_sales": ("period DATE, sales DOUBLE", f"""
        WITH g AS (SELECT period, sum({_price('total_price')}) AS n FROM ({_ORDERS}) GROUP BY period)
        SELECT period, CAST(round({_total('n')}, 2) AS DOUBLE) FROM g"""),
    "growth_orders": ("period DATE, orders BIGINT", f"""
        WITH g AS (SELECT period, count(*) AS n FROM ({_ORDERS}) GROUP BY period) SELECT period, {_total('n')} FROM g"""),
    "growth_package_orders": ("period DATE, package_orders BIGINT, package_pct DOUBLE", f"""
        WITH g AS (SELECT period, sum(CAST(use_package = 1 AS INT)) AS n, count(*) AS orders FROM ({_ORDERS}) GROUP BY period)
        SELECT period, {_total('n')}, {_share('n', 'orders', 1, 100)} FROM g"""),
    "growth_single_orders": ("period DATE, single_orders BIGINT, single_pct DOUBLE", f"""
        WITH g AS (SELECT period, sum(CAST(use_package = 0 AS INT)) AS n, count(*) AS orders FROM ({_ORDERS}) GROUP BY period)
        SELECT period, {_total('n')}, {_share('n', 'orders', 1, 100)} FROM g"""),
    "growth_washes_per_order": ("period DATE, washes_per_order DOUBLE", f"""
        WITH orders AS (SELECT id, period FROM ({_ORDERS})),
        lines AS (SELECT reservation_id, count_if(coalesce(is_product, 0) = 0 AND coalesce(is_deleted, 0) = 0) AS w
                  FROM reservation_service LEFT SEMI JOIN orders ON reservation_id = id GROUP BY reservation_id),
        g AS (SELECT period, sum(coalesce(w, 1)) AS washes, count(*) AS n
              FROM orders LEFT JOIN lines ON id = reservation_id GROUP BY period)
        SELECT period, {_share('washes', 'n', 2)} FROM g"""),
    "growth_time_to_consume": ("period DATE, avg_days_to_consume DOUBLE", f"""
        WITH used AS (SELECT subscription_id, max(created_at) AS last_use FROM reservations
                      WHERE deleted_at IS NULL AND subscription_id IS NOT NULL GROUP BY subscription_id),
        g AS (SELECT {_period('created_at')} AS period, sum(datediff(last_use, created_at)) AS d, count(*) AS n
              FROM package_subscriptions JOIN used ON id = subscription_id
              WHERE deleted_at IS NULL AND last_use IS NOT NULL AND {_dated('created_at')} GROUP BY 1)
        SELECT period, {_share('d', 'n', 1)} FROM g"""),
    "growth_aov": ("period DATE, aov DOUBLE", f"""
        WITH g AS (SELECT period, sum({_price('total_price')}) AS revenue, count(*) AS n FROM ({_ORDERS})
                   WHERE use_package = 0 GROUP BY period)
        SELECT period, {_share('revenue', 'n', 2)} FROM g"""),
    "growth_completed": ("period DATE, completed BIGINT", f"""
        WITH g AS (SELECT period, count(*) AS n FROM ({_ORDERS}) WHERE status = 3 GROUP BY period)
        SELECT period, {_total('n')} FROM g"""),
    "growth_repeat": ("period DATE, repeat_orders BIGINT, repeat_rate_pct DOUBLE", f"""
        WITH {_FIRSTS} SELECT period, {_total('(orders - newu)')}, {_share('(orders - newu)', 'orders', 1, 100)} FROM g"""),
    "growth_aopu": ("period DATE, aopu DOUBLE", f"""
        WITH {_FIRSTS} SELECT period, {_rounded("CASE WHEN grain = 'cumulative' THEN " + _ratio(
          'SUM(orders) OVER (ORDER BY period)', 'SUM(newu) OVER (ORDER BY period)') + ' ELSE ' + _ratio('orders', 'users') + ' END', 2)} FROM g"""),
}

# the account is compared where the accounts are few; orders follow by their client
_B2B = """SELECT r.*, c.username FROM reservations r JOIN clients c ON r.client_id = c.id
          WHERE r.deleted_at IS NULL AND c.id IN (SELECT id FROM b2b_accounts) AND (account IS NULL OR c.username = account)"""
_REVENUE = f"CAST(round(sum({_price('total_price')}), 0) AS DOUBLE)"
_SINGLE = f"CASE WHEN use_package = 0 THEN {_price('total_price')} END"
_AOV = _rounded(_ratio(f"sum({_SINGLE})", f"count({_SINGLE})"), 1)
_DONE = _rounded(_ratio("100 * sum(CAST(status = 3 AS INT))", "count(*)"), 1)

#: Name -> (result columns, query). All take (account).
ACCOUNTS = {
    "b2b_washes": ("washes BIGINT", f"SELECT count(*) FROM ({_B2B})"),
    "b2b_revenue": ("revenue DOUBLE", f"SELECT {_REVENUE} FROM ({_B2B})"),
    "b2b_aov": ("aov DOUBLE", f"SELECT {_AOV} FROM ({_B2B})"),
    "b2b_active_accounts": ("accounts BIGINT", f"SELECT count(DISTINCT client_id) FROM ({_B2B})"),
    "b2b_completion_pct": ("completion_pct DOUBLE", f"SELECT {_DONE} FROM ({_B2B})"),
    "b2b_account_table": (
        "account STRING, washes BIGINT, revenue DOUBLE, aov DOUBLE, package_washes BIGINT, completion_pct DOUBLE, "
        "first_order DATE, last_order DATE", f"""
        SELECT username, count(*), {_REVENUE}, {_AOV}, sum(CAST(use_package = 1 AS INT)), {_DONE},
          min(to_date(created_at)), max(to_date(created_at)) FROM ({_B2B}) GROUP BY username"""),
    "b2b_monthly_washes": ("month DATE, single BIGINT, package BIGINT", f"""
        SELECT trunc(created_at, 'MM'), sum(CAST(use_package = 0 AS INT)), sum(CAST(use_package = 1 AS INT)) FROM ({_B2B}) GROUP BY 1"""),
    "b2b_monthly_revenue": ("month DATE, revenue DOUBLE", f"SELECT trunc(created_at, 'MM'), {_REVENUE} FROM ({_B2B}) GROUP BY 1"),
    "b2b_washes_by_city": ("city STRING, washes BIGINT", f"""
        SELECT get_json_object(name, '$.ar'), sum(n) FROM (SELECT city_id, count(*) AS n FROM ({_B2B}) GROUP BY city_id)
        LEFT JOIN cities ON city_id = id GROUP BY 1"""),
}

#: How a report sorts a function's rows.
ORDER = {"b2b_account_table": "washes DESC, account", "b2b_washes_by_city": "washes DESC, city NULLS LAST",
         "b2b_monthly_washes": "month", "b2b_monthly_revenue": "month"}


def install(spark: SparkSession, t: Tables, p: Params) -> None:
    """Views and functions of this session, over the tables ``t`` and the segment of ``p``."""
    register_views(spark, t, list(VIEWS))
    accounts = t.b2b_accounts.select("id") if "b2b_accounts" in t.names() else spark.createDataFrame([(i,) for i in p.b2b_ids], "id bigint")
    accounts.createOrReplaceTempView("b2b_accounts")
    anchor = p.anchor.isoformat()
    for name, (columns, query) in GROWTH.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(grain STRING DEFAULT 'daily', date_from TIMESTAMP DEFAULT NULL, "
                  f"date_to TIMESTAMP DEFAULT NULL, anchor DATE DEFAULT DATE '{anchor}') RETURNS TABLE ({columns}) RETURN {query}")
    for name, (columns, query) in ACCOUNTS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(account STRING DEFAULT NULL) RETURNS TABLE ({columns}) RETURN {query}")


def _time(d: dt.date | None) -> dt.datetime | None:
    return dt.datetime(d.year, d.month, d.day) if d else None


def call(name: str) -> Callable[[Tables, Params], DataFrame]:
    """The report of a function: ``spark.sql`` with the parameters as named markers."""
    def run(t: Tables, p: Params) -> DataFrame:
        spark = t.reservations.sparkSession
        install(spark, t, p)
        if name in ACCOUNTS:
            order = f" ORDER BY {ORDER[name]}" if name in ORDER else ""
            return spark.sql(f"SELECT * FROM {name}(account => :account){order}", args={"account": p.account})
        text = (f"SELECT * FROM {name}(:grain, date_from => CAST(:date_from AS TIMESTAMP), date_to => CAST(:date_to AS TIMESTAMP), "
                f"anchor => :anchor) ORDER BY period")
        return spark.sql(text, args={"grain": p.effective_grain, "date_from": _time(p.date_from), "date_to": _time(p.date_to),
                                     "anchor": p.anchor})

    run.__name__ = f"sql_{name}"
    return run
