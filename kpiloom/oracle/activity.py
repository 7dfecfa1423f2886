"""Oracle SQL for first activity (S02) on its own."""

from __future__ import annotations


def first_activity(p) -> str:
    return """
SELECT client_id, min(day) AS fa FROM (
  SELECT client_id, "date" AS day FROM reservations
  WHERE deleted_at IS NULL AND status = 3 AND use_package = 0 AND coalesce("date", '') <> ''
  UNION ALL
  SELECT client_id, strftime(created_at, '%Y-%m-%d') FROM package_subscriptions WHERE deleted_at IS NULL AND status = 1)
GROUP BY client_id ORDER BY client_id"""


def customers(p, weekly: bool) -> str:
    """Orders and customers of each period: every unit looks for an earlier one of its client."""
    lo = p.anchor if weekly else p.month_start
    week = (f"strftime(DATE '{lo}' + cast(floor(date_diff('day', DATE '{lo}', cast(day AS DATE)) / 7) * 7 AS INTEGER), '%Y-%m-%d')"
            if weekly else "day")
    return f"""
SELECT period, count(*) AS total_orders, cast(coalesce(sum(amount), 0) AS DOUBLE) AS sales_sar,
  count(DISTINCT client_id) AS active_customers,
  count(DISTINCT client_id) FILTER (first_period = period) AS new_customers,
  count(DISTINCT client_id) FILTER (first_period <> period) AS returning_customers,
  cast(round(cast(count(*)::DOUBLE / nullif(count(DISTINCT client_id), 0) AS DECIMAL(18,6)), 2) AS DOUBLE) AS aopu
FROM (SELECT *, min(period) OVER (PARTITION BY client_id) AS first_period
      FROM (SELECT *, {week} AS period FROM (
        SELECT client_id, "date" AS day, coalesce(try_cast(total_price AS DECIMAL(10,2)), 0) AS amount FROM reservations
        WHERE deleted_at IS NULL AND status = 3 AND use_package = 0 AND coalesce("date", '') <> ''
        UNION ALL
        SELECT client_id, strftime(created_at, '%Y-%m-%d'), cast(cost AS DECIMAL(10,2)) FROM package_subscriptions
        WHERE deleted_at IS NULL AND status = 1)))
WHERE day >= '{lo}' AND day < '{p.today}' GROUP BY period ORDER BY period"""
