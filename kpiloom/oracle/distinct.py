"""Oracle SQL for distinct counts from stored days: plain COUNT(DISTINCT) over the facts."""

from __future__ import annotations

from kpiloom.oracle.common import d, s, week


def workers_present(p):
    return (f"""SELECT strftime("date", '%Y-%m-%d') AS period, count(DISTINCT representative_id) AS washers_available """
            f"""FROM attendances WHERE "date" >= {d(p.month_start)} AND "date" < {d(p.today)} GROUP BY 1 ORDER BY 1""")


def workers_present_weekly(p):
    return (f"""SELECT strftime({week('"date"', p.anchor)}, '%Y-%m-%d') AS period, count(DISTINCT representative_id) AS washers_available """
            f"""FROM attendances WHERE "date" >= {d(p.anchor)} AND "date" < {d(p.today)} GROUP BY 1 ORDER BY 1""")


def active_customers_weekly(p):
    return f"""SELECT strftime({week('day', p.anchor)}, '%Y-%m-%d') AS period, count(DISTINCT client_id) AS active_customers FROM (
  SELECT client_id, "date" AS day FROM reservations
  WHERE deleted_at IS NULL AND status = 3 AND use_package = 0 AND coalesce("date", '') <> ''
  UNION ALL
  SELECT client_id, strftime(created_at, '%Y-%m-%d') FROM package_subscriptions WHERE deleted_at IS NULL AND status = 1)
WHERE day >= {s(p.anchor)} AND day < {s(p.today)} GROUP BY 1 ORDER BY 1"""
