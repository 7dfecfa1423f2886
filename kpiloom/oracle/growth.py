"""Oracle SQL for the growth series (M01-M10), from the definitions of the metrics.

A series is made of rows (moment, a, b): what happened when, with a numerator and a denominator. They are summed by period; a
cumulative figure sums all periods up to its own by a join of the periods with themselves.
"""

from __future__ import annotations

from kpiloom.oracle.common import date_filter, dec, div, period, rdec, rnd


def _orders(p, columns: str, more: str = "") -> str:
    return f"SELECT created_at AS moment, {columns} FROM reservations WHERE deleted_at IS NULL{more}{date_filter('created_at', p)}"


def _series(p, rows: str, columns: dict[str, str]) -> str:
    """``columns``: name -> expression over the period's sums a and b, and c, the number of rows."""
    upto = "<=" if p.effective_grain == "cumulative" else "="
    listed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"""WITH happened AS ({rows}),
sums AS (SELECT {period('moment', p.effective_grain, p.anchor)} AS period, sum(a) AS a, sum(b) AS b, count(*) AS c FROM happened GROUP BY ALL),
totals AS (SELECT x.period, sum(y.a) AS a, sum(y.b) AS b, sum(y.c) AS c FROM sums x JOIN sums y ON y.period {upto} x.period GROUP BY x.period)
SELECT period, {listed} FROM totals ORDER BY period"""


def _flag(condition: str) -> str:
    return f"({condition})::INTEGER"


def sales(p):
    return _series(p, _orders(p, f"{dec('total_price')} AS a, 0 AS b"), {"sales": rdec("a", 2)})


def orders(p):
    return _series(p, _orders(p, "0 AS a, 0 AS b"), {"orders": "c::BIGINT"})


def _share(p, condition: str, name: str, share: str) -> str:
    return _series(p, _orders(p, f"{_flag(condition)} AS a, 1 AS b"), {name: "a::BIGINT", share: rnd(div("100 * a", "b"), 1)})


def package_orders(p):
    return _share(p, "use_package = 1", "package_orders", "package_pct")


def single_orders(p):
    return _share(p, "use_package = 0", "single_orders", "single_pct")


def washes_per_order(p):
    """An order has as many washes as lines that are neither products nor deleted, or one if it has no line at all."""
    washes = """coalesce((SELECT count(*) FILTER (coalesce(is_product, 0) = 0 AND coalesce(is_deleted, 0) = 0)
  FROM reservation_service WHERE reservation_id = reservations.id HAVING count(*) > 0), 1)"""
    return _series(p, _orders(p, f"{washes} AS a, 1 AS b"), {"washes_per_order": rnd(div("a", "b"), 2)})


def time_to_consume(p):
    """Days from the purchase of a package to its last use, by purchase."""
    rows = f"""SELECT bought.created_at AS moment, date_diff('day', bought.created_at::DATE, last_use::DATE) AS a, 1 AS b
FROM package_subscriptions bought
JOIN (SELECT DISTINCT ON (subscription_id) subscription_id, created_at AS last_use FROM reservations
      WHERE deleted_at IS NULL AND subscription_id IS NOT NULL ORDER BY subscription_id, created_at DESC NULLS LAST) used
  ON used.subscription_id = bought.id
WHERE bought.deleted_at IS NULL AND last_use IS NOT NULL{date_filter('bought.created_at', p)}"""
    return _series(p, rows, {"avg_days_to_consume": rnd(div("a", "b"), 1)})


def aov(p):
    return _series(p, _orders(p, f"{dec('total_price')} AS a, 1 AS b", " AND use_package = 0"), {"aov": rnd(div("a", "b"), 2)})


def completed(p):
    return _series(p, _orders(p, "0 AS a, 0 AS b", " AND status = 3"), {"completed": "c::BIGINT"})


#: An order has an earlier one of its client (of the same time: the one of smaller id) in the range.
REPEATED = "lag(id) OVER (PARTITION BY client_id ORDER BY created_at, id) IS NOT NULL"


def repeat(p):
    return _series(p, _orders(p, f"{_flag(REPEATED)} AS a, 1 AS b"),
                   {"repeat_orders": "a::BIGINT", "repeat_rate_pct": rnd(div("100 * a", "b"), 1)})


def aopu(p):
    """A period's users: clients with an order in it; up to a period: clients whose first order it holds, summed."""
    key = period("created_at", p.effective_grain, p.anchor)
    first_of = "client_id" if p.effective_grain == "cumulative" else f"client_id, {key}"
    known = "TRUE" if p.effective_grain == "cumulative" else "client_id IS NOT NULL"
    first = f"lag(id) OVER (PARTITION BY {first_of} ORDER BY created_at, id) IS NULL AND {known}"
    return _series(p, _orders(p, f"1 AS a, {_flag(first)} AS b"), {"aopu": rnd(div("a", "b"), 2)})


GROWTH_SQL = {
    "growth_sales": sales,
    "growth_orders": orders,
    "growth_package_orders": package_orders,
    "growth_single_orders": single_orders,
    "growth_washes_per_order": washes_per_order,
    "growth_time_to_consume": time_to_consume,
    "growth_aov": aov,
    "growth_completed": completed,
    "growth_repeat": repeat,
    "growth_aopu": aopu,
}
