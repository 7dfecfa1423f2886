"""The OKR cards M11 to M24 as parts of a fused board (plans/fused.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.functions.exprs import dec, hours_between, pct, ratio, rnd, rnd_dec
from kpiloom.plans.fused import Card

_done = lambda: F.col("status") == 3
_flag = lambda c, v: lambda: (F.col(c) == v).cast("int")
_by_worker = lambda: _done() & F.col("representative_id").isNotNull()
_hours = lambda: hours_between("created_at", "answer_at")
_price = lambda: dec("total_price")
_is = lambda *names: lambda: {n: F.col(n) for n in names}

OKR_CARDS = [
    Card("okr_sales", "reservations", lambda: {"sales": rnd_dec("total", 2)}, sums={"total": _price}),
    Card("okr_orders", "reservations", _is("orders"), counts={"orders": None}),
    Card("okr_package_share", "reservations", lambda: {
        "package_orders": F.col("package_orders"), "package_pct": pct("package_orders", "orders")},
        sums={"package_orders": _flag("use_package", 1)}, counts={"orders": None}),
    Card("okr_single_share", "reservations", lambda: {
        "single_orders": F.col("single_orders"), "single_pct": pct("single_orders", "orders")},
        sums={"single_orders": _flag("use_package", 0)}, counts={"orders": None}),
    Card("okr_aov", "reservations", lambda: {"aov": rnd(ratio("total", "priced"), 2)},
         rows=lambda: F.col("use_package") == 0, sums={"total": _price}, counts={"priced": _price}),
    Card("okr_completed", "reservations", _is("completed"), rows=_done, counts={"completed": None}),
    Card("okr_per_washer_per_day", "reservations", lambda: {
        "per_washer_per_day": rnd(ratio("completed", F.col("workers") * F.col("days")), 2)},
        rows=_by_worker, counts={"completed": None}, distinct={"workers": "worker", "days": "worked_day"}, grains=("monthly",)),
    Card("okr_per_washer_daily", "reservations", lambda: {"per_washer": rnd(ratio("completed", "workers"), 2)},
         rows=_by_worker, counts={"completed": None}, distinct={"workers": "worker"}, grains=("daily",)),
    Card("okr_completed_from_packages", "reservations", _is("completed_from_packages"),
         rows=lambda: _done() & (F.col("use_package") == 1), counts={"completed_from_packages": None}),
    Card("okr_new_companies", "companies", _is("new_companies"), counts={"new_companies": None}, live=False),
    Card("okr_leads", "corporate_wash_leads", _is("leads", "contacted"), counts={"leads": None},
         sums={"contacted": lambda: (F.col("contact_status") > 0).cast("int")}, live=False),
    Card("okr_csat", "reviews", lambda: {"avg_score": rnd(ratio("total", "scored"), 2), "csat_pct": pct("good", "reviews")},
         sums={"total": lambda: F.col("score"), "good": lambda: (F.col("score") >= 4).cast("int")},
         counts={"scored": lambda: F.col("score"), "reviews": None}),
    Card("okr_complaint_resolution_hours", "client_complaints", lambda: {"avg_hours": rnd(ratio("hours", "answered"), 1)},
         rows=lambda: F.col("answer_at").isNotNull(), sums={"hours": _hours}, counts={"answered": _hours}),
    Card("okr_complaints", "client_complaints", _is("issues"), counts={"issues": None}),
]
