"""Oracle SQL for the OKR cards."""

from __future__ import annotations

import datetime as dt

from kpiloom.oracle.common import date_filter, dec, div, hours, rdec, rnd, ts


def _k(p, col="created_at"):
    if p.effective_grain == "monthly":
        return f"cast(date_trunc('month', {col}) AS DATE)", "month"
    return f"cast({col} AS DATE)", "day"


def _card(p, select, frm, where="TRUE", grain=None):
    q = p.with_(grain=grain) if grain else p
    k, name = _k(q)
    return (f"SELECT {k} AS {name}, {select} FROM {frm} WHERE {where}{date_filter('created_at', q)} "
            f"GROUP BY 1 ORDER BY 1")


LIVE = "deleted_at IS NULL"
PRICE = dec("total_price")


def sales(p):
    return _card(p, f"{rdec(f"SUM({PRICE})", 2)} AS sales", "reservations", LIVE)


def orders(p):
    return _card(p, "COUNT(*) AS orders", "reservations", LIVE)


def package_share(p):
    return _card(p, "cast(SUM(CASE WHEN use_package = 1 THEN 1 ELSE 0 END) AS BIGINT) AS package_orders, "
                 f"{rnd(div('100 * cast(SUM(CASE WHEN use_package = 1 THEN 1 ELSE 0 END) AS BIGINT)', 'COUNT(*)'), 1)} AS package_pct",
                 "reservations", LIVE)


def single_share(p):
    return _card(p, "cast(SUM(CASE WHEN use_package = 0 THEN 1 ELSE 0 END) AS BIGINT) AS single_orders, "
                 f"{rnd(div('100 * cast(SUM(CASE WHEN use_package = 0 THEN 1 ELSE 0 END) AS BIGINT)', 'COUNT(*)'), 1)} AS single_pct",
                 "reservations", LIVE)


def aov(p):
    x = dec("total_price")
    return _card(p, f"{rnd(div(f'SUM({x})', f'COUNT({x})'), 2)} AS aov", "reservations",
                 f"{LIVE} AND use_package = 0")


def completed(p):
    return _card(p, "COUNT(*) AS completed", "reservations", f"{LIVE} AND status = 3")


def new_companies(p):
    return _card(p, "COUNT(*) AS new_companies", "companies")


def leads(p):
    return _card(p, "COUNT(*) AS leads, cast(SUM(CASE WHEN contact_status > 0 THEN 1 ELSE 0 END) AS BIGINT) AS contacted",
                 "corporate_wash_leads")


def per_washer_per_day(p):
    inner = _card(p, "COUNT(*) AS completed, COUNT(DISTINCT representative_id) AS reps, "
                  "COUNT(DISTINCT cast(created_at AS DATE)) AS days", "reservations",
                  f"{LIVE} AND status = 3 AND representative_id IS NOT NULL", grain="monthly")
    return (f"SELECT month, {rnd(div('completed', 'reps * days'), 2)} AS per_washer_per_day "
            f"FROM ({inner}) t ORDER BY month")


def per_washer_daily(p):
    inner = _card(p, "COUNT(*) AS completed, COUNT(DISTINCT representative_id) AS reps", "reservations",
                  f"{LIVE} AND status = 3 AND representative_id IS NOT NULL", grain="daily")
    return f"SELECT day, {rnd(div('completed', 'reps'), 2)} AS per_washer FROM ({inner}) t ORDER BY day"


def completed_from_packages(p):
    return _card(p, "COUNT(*) AS completed_from_packages", "reservations",
                 f"{LIVE} AND status = 3 AND use_package = 1")


def csat(p):
    return _card(p, f"{rnd(div('SUM(score)', 'COUNT(score)'), 2)} AS avg_score, "
                 f"{rnd(div('100 * cast(SUM(CASE WHEN score >= 4 THEN 1 ELSE 0 END) AS BIGINT)', 'COUNT(*)'), 1)} AS csat_pct",
                 "reviews", LIVE)


def complaint_resolution_hours(p):
    h = hours("created_at", "answer_at")
    return _card(p, f"{rnd(div(f'SUM({h})', f'COUNT({h})'), 1)} AS avg_hours", "client_complaints",
                 f"{LIVE} AND answer_at IS NOT NULL")


def complaints(p):
    return _card(p, "COUNT(*) AS issues", "client_complaints", LIVE)


def last_n_days(p):
    n = p.last_days if p.last_days is not None else 30
    lo = p.today - dt.timedelta(days=n)
    return (f"SELECT cast(created_at AS DATE) AS day, {rdec(f"SUM({PRICE})", 2)} AS sales "
            f"FROM reservations WHERE {LIVE} AND created_at >= {ts(lo)} GROUP BY 1 ORDER BY 1")


OKR_SQL = {
    "okr_sales": sales,
    "okr_orders": orders,
    "okr_package_share": package_share,
    "okr_single_share": single_share,
    "okr_aov": aov,
    "okr_completed": completed,
    "okr_new_companies": new_companies,
    "okr_leads": leads,
    "okr_per_washer_per_day": per_washer_per_day,
    "okr_per_washer_daily": per_washer_daily,
    "okr_completed_from_packages": completed_from_packages,
    "okr_csat": csat,
    "okr_complaint_resolution_hours": complaint_resolution_hours,
    "okr_complaints": complaints,
    "sales_last_n_days": last_n_days,
}


#: Value columns of the cards on a board.
CARD_METRICS = {
    "okr_sales": ("sales",), "okr_orders": ("orders",), "okr_package_share": ("package_orders", "package_pct"),
    "okr_single_share": ("single_orders", "single_pct"), "okr_aov": ("aov",), "okr_completed": ("completed",),
    "okr_new_companies": ("new_companies",), "okr_leads": ("leads", "contacted"),
    "okr_per_washer_per_day": ("per_washer_per_day",), "okr_per_washer_daily": ("per_washer",),
    "okr_completed_from_packages": ("completed_from_packages",), "okr_csat": ("avg_score", "csat_pct"),
    "okr_complaint_resolution_hours": ("avg_hours",), "okr_complaints": ("issues",),
}


def board(p):
    """Every card's own query, one after the other, as long rows."""
    skip = "okr_per_washer_per_day" if p.effective_grain == "daily" else "okr_per_washer_daily"
    key = "month" if p.effective_grain == "monthly" else "day"
    rows = [f"SELECT '{card}' AS card, {key} AS period, '{m}' AS metric, cast({m} AS DOUBLE) AS value FROM ({OKR_SQL[card](p)}) t"
            for card, metrics in CARD_METRICS.items() if card != skip for m in metrics]
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ") ORDER BY card, period, metric"
