"""Oracle SQL for the weekly KPIs (M59-M65) and the daily purchase breakdown (M67), from the definitions of the metrics.

Each report gathers what it counts as rows (key, kind, who) of one relation and takes filtered counts by key.
"""

from __future__ import annotations

import datetime as dt

from kpiloom.oracle.common import d, div, ids, rnd, s, ts, week

DONE = "deleted_at IS NULL AND status = 3"


def _by_key(rows: list[str], select: str, more: str = "") -> str:
    return f"WITH counted(key, kind, who) AS ({' UNION ALL '.join(rows)})\nSELECT {select} FROM counted GROUP BY key {more}"


def _n(kind: str) -> str:
    return f"count(*) FILTER (kind = '{kind}')"


def _who(kind: str) -> str:
    return f"count(DISTINCT who) FILTER (kind = '{kind}')"


def _served_and_present(p, lo: dt.date, key) -> list[str]:
    return [f"""SELECT {key('"date"::DATE')}, 'wash', NULL FROM reservations WHERE {DONE} AND "date" >= {s(lo)} AND "date" < {s(p.today)}""",
            f"""SELECT {key('"date"')}, 'present', representative_id FROM attendances WHERE "date" >= {d(lo)} AND "date" < {d(p.today)}"""]


#: Only where orders were served and workers were present.
BOTH = f"HAVING {_n('wash')} > 0 AND {_n('present')} > 0"


def north_star_weighted(p):
    days = _by_key(_served_and_present(p, p.date_from or p.anchor, lambda x: x), f"{_n('wash')} AS washes, {_who('present')} AS workers", BOTH)
    return f"SELECT {rnd(div('sum(washes)', 'sum(workers)'), 2)} AS washes_per_washer_daily FROM ({days}) days"


def north_star_per_week(p):
    return _by_key(_served_and_present(p, p.anchor, lambda x: week(x, p.anchor)),
                   f"key AS week_start, {rnd(div(_n('wash'), _who('present')), 2)} AS washes_per_washer_week", f"{BOTH} ORDER BY key")


def _paid(key: str, name: str, where: str) -> str:
    rows = [f"SELECT {key}, CASE use_package WHEN 1 THEN 'package' WHEN 0 THEN 'single' END, NULL FROM reservations WHERE deleted_at IS NULL{where}"]
    return _by_key(rows, f"key AS {name}, {_n('single')} AS single_washes, {_n('package')} AS package_washes" + (
        ", count(*) AS total_paid_washes" if name == "week_start" else ""), "ORDER BY key")


def weekly_paid_washes(p):
    return _paid(week("created_at", p.anchor), "week_start", f" AND created_at >= {ts(p.anchor)}")


def monthly_paid_washes(p):
    return _paid("date_trunc('month', created_at)::DATE", "month", "")


def _purchases(p, key, where: str) -> list[str]:
    """Single orders, and paid packages of the catalogue once as their kind and once more if on offer."""
    sold = f"""FROM package_subscriptions JOIN packages ON packages.id = package_id
  WHERE deleted_at IS NULL AND status = 1 AND {where}"""
    return [f"SELECT {key}, 'single', NULL FROM reservations WHERE deleted_at IS NULL AND use_package = 0 AND {where}",
            f"SELECT {key}, if(is_customized = 1, 'own', 'standard'), NULL {sold}",
            f"SELECT {key}, 'offer', NULL {sold} AND package_id IN ({ids(p.offer_package_ids)})"]


PURCHASES = (f"{_n('single')} AS single_purchased, {_n('own')} AS pkg_customized, {_n('standard')} AS pkg_non_customized, "
             f"{_n('offer')} AS bogo_free_wash")


def weekly_purchase_breakdown(p):
    """Weeks with any order; packages bought in other weeks are not listed."""
    key, where = f"strftime({week('created_at', p.anchor)}, '%Y-%m-%d')", f"created_at >= {ts(p.anchor)}"
    any_order = f"SELECT {key}, 'order', NULL FROM reservations WHERE deleted_at IS NULL AND {where}"
    return _by_key([any_order, *_purchases(p, key, where)], f"key AS week, {PURCHASES}", f"HAVING {_n('order')} > 0 ORDER BY key DESC")


def daily_purchase_breakdown(p):
    lo = p.today - dt.timedelta(days=60 if p.last_days is None else p.last_days)
    rows = _purchases(p, "strftime(created_at, '%Y-%m-%d')", f"created_at >= {ts(lo)} AND created_at < {ts(p.today)}")
    return _by_key(rows, f"key AS day, {PURCHASES}", "ORDER BY key DESC")


def weekly_worker_efficiency(p):
    """Jobs done for each worker with one done, against jobs for each worker with one."""
    jobs = f"""FROM reservations WHERE deleted_at IS NULL AND representative_id IS NOT NULL AND "date" >= {s(p.anchor)} AND "date" < {s(p.today)}"""
    key = week('"date"', p.anchor)
    rows = [f"SELECT {key}, 'given', representative_id {jobs}", f"SELECT {key}, 'done', representative_id {jobs} AND status = 3"]
    load = lambda kind: div(_n(kind), _who(kind))
    return _by_key(rows, f"key AS week, {rnd(div(f'100 * {load('done')}', load('given')), 1)} AS efficiency_pct", "ORDER BY key")


def weekly_assignment_efficiency(p):
    """Weeks with a visit to the page without slots."""
    key, where = week("created_at", p.anchor), f"created_at >= {ts(p.anchor)} AND created_at < {ts(p.today)}"
    rows = [f"SELECT {key}, 'visit', NULL FROM user_area_availability_alert_logs WHERE {where}",
            f"SELECT {key}, 'order', NULL FROM reservations WHERE deleted_at IS NULL AND {where}"]
    return _by_key(rows, f"key AS week, {_n('visit')} AS visits, {_n('order')} AS orders, "
                         f"{rnd(div(_n('visit'), _n('order')), 3)} AS assignment_efficiency", f"HAVING {_n('visit')} > 0 ORDER BY key")


WEEKLY_SQL = {f.__name__: f for f in (
    north_star_weighted, north_star_per_week, weekly_paid_washes, weekly_purchase_breakdown,
    weekly_worker_efficiency, weekly_assignment_efficiency, monthly_paid_washes, daily_purchase_breakdown)}
