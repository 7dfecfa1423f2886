"""Oracle SQL for the segment analytics (M26-M49), from the definitions of the metrics.

Every query reads one relation ``served``: the orders that are not deleted, each with its price as a number, its month and
day, whether its client is one of the accounts (NULL for no client), and the account's name.
"""

from __future__ import annotations

import datetime as dt

from kpiloom.oracle.common import dec, div, ids, rdec, rnd, ts


def _served(p, keep: str, since: dt.date | None = None, more: str = "") -> str:
    late = f" AND created_at >= {ts(since)}" if since else ""
    return f"""WITH served AS (
  SELECT o.client_id, {more}o.use_package, o.status, {dec('o.total_price')} AS price, o.created_at::DATE AS day,
         date_trunc('month', o.created_at)::DATE AS month, list_contains([{ids(p.b2b_ids)}], o.client_id) AS is_account, a.username AS account
  FROM (SELECT * FROM reservations WHERE deleted_at IS NULL{late}) o LEFT JOIN clients a ON a.id = o.client_id
  WHERE {keep})
"""


def _city(sql: str) -> str:
    """The long order history has no city."""
    return "o.city_id, " if "city_id" in sql else ""


def _of_accounts(p, sql: str) -> str:
    """Orders of the segment's accounts that are in the client table; of one account, if it is asked for."""
    name = "" if p.account is None else f"AND a.username = '{p.account}'"
    if p.ci_text and p.account is not None:
        name = f"AND upper(a.username) = upper('{p.account}')"
    return _served(p, f"is_account AND a.id IS NOT NULL {name}", more=_city(sql)) + sql


def _of_individuals(p, sql: str) -> str:
    """Orders of known clients outside the segment."""
    return _served(p, "NOT is_account", more=_city(sql)) + sql


N = "count(*)"
SINGLE, PACKAGE, DONE = (f"count(*) FILTER ({x})" for x in ("use_package = 0", "use_package = 1", "status = 3"))
REVENUE = rdec("sum(price)", 0)
AOV = rnd(div("sum(price) FILTER (use_package = 0)", "count(price) FILTER (use_package = 0)"), 1)
COMPLETED = rnd(div(f"100 * {DONE}", N), 1)
CLIENTS = "count(DISTINCT client_id)"
# of a client's n orders all but the first are repeats
REPEATS = f"({N} - {CLIENTS})"
CITY = """SELECT name->>'$.ar' AS city, count(*) AS washes FROM served LEFT JOIN cities ON cities.id = city_id
GROUP BY ALL ORDER BY washes DESC, city NULLS LAST"""
BY_MONTH = "FROM served GROUP BY month ORDER BY month"


def _one(sql: str, name: str) -> str:
    return f"SELECT {sql} AS {name} FROM served"


def _accounts(sql: str):
    return lambda p: _of_accounts(p, sql)


def _individuals(sql: str):
    return lambda p: _of_individuals(p, sql)


def _days(p, days: int, columns: str, order: str = "DESC") -> str:
    since = None if days == 0 else p.today - dt.timedelta(days=days if p.last_days is None else p.last_days)
    return _served(p, "true", since) + f"SELECT day, {columns} FROM served GROUP BY day ORDER BY day {order}"


#: (order, client) pairs become one row for each client and month, numbered in the client's order.
MONTHS_OF_CLIENTS = """, months AS (
  SELECT client_id, month, count(*) AS n, row_number() OVER (PARTITION BY client_id ORDER BY month) AS nth FROM served GROUP BY client_id, month)
"""
#: Fixed labels of the histogram and the least number of orders of each.
BUCKETS = {"1 (once)": 1, "2": 2, "3-5": 3, "6-10": 6, "11+": 11}

# a day without an order of a known client has no split
SPLIT = ("CASE WHEN count(client_id) > 0 THEN count(*) FILTER (NOT is_account) END AS individual_orders, "
         "CASE WHEN count(client_id) > 0 THEN count(*) FILTER (is_account) END AS b2b_orders")
# nor has a day whose only orders are completed ones of unknown clients
_KNOWN = "count(*) FILTER (status <> 3 OR client_id IS NOT NULL) > 0"
SPLIT_DONE = (f"CASE WHEN {_KNOWN} THEN count(*) FILTER (status = 3 AND is_account) END AS b2b_completed, "
              f"CASE WHEN {_KNOWN} THEN count(*) FILTER (status = 3 AND NOT is_account) END AS individual_completed")


def _histogram(p) -> str:
    least = list(BUCKETS.items())
    steps = ", ".join(f"('{label}', {low}, {least[i + 1][1] - 1 if i + 1 < len(least) else 10**12})" for i, (label, low) in enumerate(least))
    return _of_individuals(p, f"""SELECT bucket, count(*) AS customers
FROM (SELECT client_id, count(*) AS n FROM served GROUP BY client_id) JOIN (VALUES {steps}) buckets(bucket, low, high) ON n BETWEEN low AND high
GROUP BY bucket, low ORDER BY low""")


SEGMENTS_SQL = {
    "b2b_washes": _accounts(_one(N, "washes")),
    "b2b_revenue": _accounts(_one(REVENUE, "revenue")),
    "b2b_aov": _accounts(_one(AOV, "aov")),
    "b2b_active_accounts": _accounts(_one(CLIENTS, "accounts")),
    "b2b_completion_pct": _accounts(_one(COMPLETED, "completion_pct")),
    "b2b_account_table": _accounts(f"""SELECT account, {N} AS washes, {REVENUE} AS revenue, {AOV} AS aov, {PACKAGE} AS package_washes,
  {COMPLETED} AS completion_pct, min(day) AS first_order, max(day) AS last_order FROM served GROUP BY account ORDER BY washes DESC, account"""),
    "b2b_monthly_washes": _accounts(f"SELECT month, {SINGLE} AS single, {PACKAGE} AS package {BY_MONTH}"),
    "b2b_monthly_revenue": _accounts(f"SELECT month, {REVENUE} AS revenue {BY_MONTH}"),
    "b2b_washes_by_city": _accounts(CITY),
    "indiv_customers": _individuals(_one(CLIENTS, "customers")),
    "indiv_washes": _individuals(_one(N, "washes")),
    "indiv_revenue": _individuals(_one(REVENUE, "revenue")),
    "indiv_aov": _individuals(_one(AOV, "aov")),
    "indiv_repeat_rate": _individuals(_one(rnd(div(f"100 * {REPEATS}", N), 1), "repeat_rate_pct")),
    "indiv_aopu": _individuals(_one(rnd(div(N, CLIENTS), 2), "aopu")),
    "indiv_monthly_washes": _individuals(f"SELECT month, {SINGLE} AS single, {PACKAGE} AS package {BY_MONTH}"),
    "indiv_monthly_revenue": _individuals(f"SELECT month, {REVENUE} AS revenue {BY_MONTH}"),
    "indiv_new_vs_returning": lambda p: _of_individuals(p, "").rstrip() + MONTHS_OF_CLIENTS + """
SELECT month, count(*) FILTER (nth = 1) AS new_customers, count(*) FILTER (nth > 1) AS returning_customers FROM months GROUP BY month ORDER BY month""",
    # in a client's first month all orders but one are repeats, later all are
    "indiv_repeat_trend": lambda p: _of_individuals(p, "").rstrip() + MONTHS_OF_CLIENTS + f"""
SELECT month, {rnd(div("100 * sum(CASE nth WHEN 1 THEN n - 1 ELSE n END)", "sum(n)"), 1)} AS repeat_rate_pct FROM months GROUP BY month ORDER BY month""",
    "indiv_order_histogram": _histogram,
    "indiv_top_cities": _individuals(CITY + " LIMIT 10"),
    "daily_segment_orders": lambda p: _days(p, 0, SPLIT, "ASC"),
    "daily_segment_table": lambda p: _days(p, 60, f"{SPLIT}, {N} AS total_orders"),
    "daily_completed_by_segment": lambda p: _days(p, 90, f"{SPLIT_DONE}, {DONE} AS total_completed, {N} AS total_orders"),
}
