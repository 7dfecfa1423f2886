"""OKR scoreboards.

Month-to-date daily scoreboard (M55/M56) and its weekly form anchored at
``Params.anchor`` (M57), with period-over-period changes, and the weekly
indicator matrix (M58, unpivot + pivot).

Plan shape: every component (S02-S14) aggregates to one row per period on its
own date column: service day (text ``date``), purchase time (``created_at``),
attendance date. The only fact-sized shuffles are the all-time first-activity
aggregate per client (S02, hash-aggregated MIN over day text) and one (period, client)
aggregate that feeds orders, customers, washes and purchases (S03-S07, S10, S12) through a
single join with it; that aggregate reads each fact table once. The period
spine (S15) and the outer merge of the components (S16) only touch per-period
rows: they are one UNION ALL + GROUP BY period, not a chain of joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (bsum, day_str, dec, in_range, live, pct, ratio, rnd, to_dbl, week_str)
from kpiloom.functions.windows import merge_on_key, min_day_text, prev_gap_minutes
from kpiloom.operators.activity import first_activity_rows
from kpiloom.operators.weekly import _package_breakdown, worker_load
from kpiloom.params import Params
from kpiloom.sources.tables import Tables


def _n() -> Column:
    return F.count(F.lit(1))


class Grain:
    """S01 bounds + period keys. Daily: [month start, today) keyed by 'YYYY-MM-DD';
    weekly: [anchor, today) keyed by the anchored week start 'YYYY-MM-DD'."""

    def __init__(self, p: Params, weekly: bool):
        self.p, self.weekly = p, weekly
        self.lo = p.anchor if weekly else p.month_start
        self.hi = p.today

    def key_text(self, x: str | Column) -> Column:
        """Period of a text day column ('YYYY-MM-DD')."""
        x = F.col(x) if isinstance(x, str) else x
        return week_str(x, self.p.anchor) if self.weekly else x

    def key_time(self, x: str | Column) -> Column:
        """Period of a timestamp / date column."""
        return week_str(x, self.p.anchor) if self.weekly else day_str(x)

    def text_in_range(self, col: str = "date") -> Column:
        return (F.col(col) >= F.lit(self.lo.isoformat())) & (F.col(col) < F.lit(self.hi.isoformat()))

    def time_in_range(self, col: str = "created_at") -> Column:
        return in_range(col, self.lo, self.hi)


def first_activity(t: Tables) -> DataFrame:
    """Per client, first day (text) of a completed single order or a paid package, all time
    (MIN over day text, planned as hash aggregates by ``min_day_text``).
    A ``first_activity`` table (plans/activity_store.py, plans/materialize.py) is used when present."""
    if "first_activity" in t.names():
        return t.first_activity.select("client_id", "fa")
    return min_day_text(first_activity_rows(t), "client_id", "act", "fa")


def service_units(t: Tables, g: Grain) -> DataFrame:
    """S03 inputs, the completed washes of S07, the purchases of S10/S12 and (weekly) the
    worker load of S14, from one scan of each fact table, as one (period, client, worker)
    aggregate.

    Completed reservations count by service day (``date`` text); single reservations of any
    status count as purchases by creation day; paid packages count by purchase day in both
    roles; on the weekly grain, every assigned reservation counts for its worker by service
    day. A reservation can play several roles on different keys, so each row emits up to
    three tagged rows (``inline`` of a filtered array, no second scan). Purchase and worker
    rows carry a NULL client: they never match first activity. Worker rows carry the worker
    id, so each (period, NULL, worker) group is one worker of the period.
    n_done: completed washes; n_single: completed single orders (order units); n_pkg: paid
    packages (order units); amount: order-unit value (single price / package cost);
    n_bought: single purchases; n_assigned / n_exec: a worker's assigned / executed jobs."""
    single = F.col("use_package") == 0
    served = (F.col("status") == 3) & g.text_in_range("date")
    bought = single & g.time_in_range()
    worked = F.col("representative_id").isNotNull() & g.text_in_range("date") if g.weekly else F.lit(False)
    price = dec("total_price", 10, 2)
    no_client, no_rep = F.lit(None).cast("bigint").alias("client_id"), F.lit(None).cast("bigint").alias("rep")
    no_amount = F.lit(None).cast("decimal(10,2)").alias("amount")
    zero = lambda name: F.lit(0).alias(name)
    as_served = F.struct(g.key_text("date").alias("day"), F.col("client_id"), no_rep, F.lit(1).alias("done"),
                         single.cast("int").alias("single"), F.when(single, price).alias("amount"),
                         zero("bought"), zero("assigned"), zero("executed"))
    as_bought = F.struct(g.key_time("created_at").alias("day"), no_client, no_rep, zero("done"), zero("single"),
                         no_amount, F.lit(1).alias("bought"), zero("assigned"), zero("executed"))
    as_worker = F.struct(g.key_text("date").alias("day"), no_client, F.col("representative_id").alias("rep"),
                         zero("done"), zero("single"), no_amount, zero("bought"), F.lit(1).alias("assigned"),
                         (F.col("status") == 3).cast("int").alias("executed"))
    tagged = F.array(F.when(served, as_served), F.when(bought, as_bought), F.when(worked, as_worker))
    r = (live(t.reservations).where(served | bought | worked)
         .select(F.inline(F.filter(tagged, lambda x: x.isNotNull())))
         .withColumn("pkg", F.lit(0)))
    s = (live(t.package_subscriptions).where((F.col("status") == 1) & g.time_in_range())
         .select(g.key_time("created_at").alias("day"), "client_id", no_rep, zero("done"), zero("single"),
                 F.col("cost").cast("decimal(10,2)").alias("amount"), zero("bought"), zero("assigned"),
                 zero("executed"), F.lit(1).alias("pkg")))
    return r.unionByName(s).groupBy("day", "client_id", "rep").agg(
        F.sum("done").alias("n_done"), F.sum("single").alias("n_single"), F.sum("pkg").alias("n_pkg"),
        F.sum("amount").alias("amount"), F.sum("bought").alias("n_bought"),
        F.sum("assigned").alias("n_assigned"), F.sum("executed").alias("n_exec"))


def orders_customers_washes(t: Tables, fa: DataFrame, g: Grain) -> DataFrame:
    """S04 orders, S05+S06 customers, S07 washes, S10/S12 purchases and (weekly) S14 worker
    load from one (period, client, worker) aggregate joined once to first activity (the only
    fact-sized join of the scoreboard; both sides are one row per client or per (period,
    client)).

    NULL semantics of the source are kept: a client absent from ``fa`` is not a customer
    (inner join there) but its washes count, with a NULL new/returning split (left join);
    SUM over no non-NULL flag stays NULL until the final COALESCE. Purchase and worker rows
    have zero units and washes, so they add nothing to the other metrics; a worker is a
    (period, NULL, worker) group, so counting those groups counts distinct workers."""
    u = service_units(t, g)
    # purchase and worker rows have no client: a key of their own each deals them out over all tasks of the join
    keyed = u.withColumn("_none", F.col("client_id").isNull()).withColumn(
        "_key", F.when(F.col("client_id").isNull(), F.xxhash64("day", "rep")).otherwise(F.col("client_id")))
    known = fa.where(F.col("client_id").isNotNull()).select(
        F.col("client_id").alias("_key"), F.lit(False).alias("_none"), "fa", F.lit(True).alias("in_fa"))
    j = keyed.join(known, ["_key", "_none"], "left")
    same = g.key_text(F.col("fa")) == F.col("day")
    washed, unit = F.col("n_done") > 0, (F.col("n_single") + F.col("n_pkg") > 0) & F.col("in_fa").isNotNull()
    washes_new = F.sum(F.when(washed & same, F.col("n_done")).when(washed & ~same, F.lit(0)))
    new_cust = F.sum(F.when(unit, same.cast("int")))
    active = F.count(F.when(unit, 1))
    return j.groupBy("day").agg(
        F.sum("n_pkg").alias("package_orders"), F.sum("n_single").alias("single_orders"),
        F.sum(F.col("n_single") + F.col("n_pkg")).alias("total_orders"), F.sum("amount").alias("sales_sar"),
        F.sum("n_done").alias("completed_washes"), washes_new.alias("washes_new_cust"),
        (F.sum("n_done") - washes_new).alias("washes_returning_cust"),
        active.alias("active_customers"), new_cust.alias("new_customers"),
        (active - new_cust).alias("returning_customers"),
        (F.sum("n_bought") + F.sum("n_pkg")).alias("purchased_orders"), F.sum("n_bought").alias("single_purchased"),
        *([F.sum("n_assigned").alias("assigned"), F.count(F.when(F.col("n_assigned") > 0, 1)).alias("asg_washers"),
           F.sum("n_exec").alias("executed"), F.count(F.when(F.col("n_exec") > 0, 1)).alias("exec_washers")]
          if g.weekly else []))


def signups_component(t: Tables, g: Grain) -> DataFrame:
    """S08"""
    c = t.clients.where((F.col("type") == 0) & g.time_in_range())
    return c.groupBy(g.key_time("created_at").alias("day")).agg(_n().alias("signups"))


def attendance_component(t: Tables, g: Grain) -> DataFrame:
    """S09"""
    a = t.attendances.where((F.col("date") >= F.lit(g.lo)) & (F.col("date") < F.lit(g.hi)))
    return a.groupBy(g.key_time("date").alias("day")).agg(F.countDistinct("representative_id").alias("washers_available"))


def between_component(t: Tables, g: Grain) -> DataFrame:
    """Mean idle minutes between consecutive jobs of a worker on a service day (0..max)."""
    r = live(t.reservations).where(
        (F.col("status") == 3) & F.col("representative_id").isNotNull() & F.col("representative_start_at").isNotNull()
        & F.col("representative_end_at").isNotNull() & F.col("date").isNotNull() & g.text_in_range("date"))
    r = r.select("representative_id", "date", "representative_start_at", "representative_end_at")
    # LEAD(start) - end on each row gives the same consecutive pairs as start - LAG(end); the LAG
    # form reads only the window's own columns, so the skew-safe lookup scans and shuffles once
    x = prev_gap_minutes(r, ["representative_id", "date"], "representative_start_at", "representative_end_at")
    x = x.where(F.col("gap").between(0, g.p.max_gap_minutes))
    return x.groupBy(g.key_text("date").alias("day")).agg(
        rnd(ratio(F.sum("gap"), F.count("gap")), 1).alias("avg_min_between_washes"))


def package_breakdown_component(t: Tables, g: Grain) -> DataFrame:
    """S13"""
    return _package_breakdown(t, g.p, g.key_time, g.lo, g.hi).withColumnRenamed("k", "day")


def efficiency_component(t: Tables, g: Grain) -> DataFrame:
    """S14 on its own: assigned / executed jobs and the distinct workers behind each. The
    weekly scoreboard takes the same numbers from the shared aggregate of ``service_units``."""
    r = live(t.reservations).where(F.col("representative_id").isNotNull() & g.text_in_range("date"))
    return worker_load(r, g.key_text("date").alias("day"), "day")


COUNTS = ["package_orders", "single_orders", "total_orders", "sales_sar", "completed_washes", "washes_new_cust",
          "washes_returning_cust", "active_customers", "new_customers", "returning_customers", "signups",
          "washers_available", "purchased_orders"]


def scoreboard_base(t: Tables, p: Params, weekly: bool, breakdown: bool) -> DataFrame:
    """Period spine, left joins of every component, ratios."""
    g = Grain(p, weekly)
    fa = first_activity(t)
    ocw = orders_customers_washes(t, fa, g)
    comps = [ocw if breakdown and not weekly else ocw.drop("single_purchased"), signups_component(t, g),
             attendance_component(t, g), between_component(t, g)]
    extra: list[str] = []
    if weekly:
        # S14 worker load rides in the (period, client, worker) aggregate of orders_customers_washes
        extra = ["assigned", "asg_washers", "executed", "exec_washers"]
    elif breakdown:
        comps.append(package_breakdown_component(t, g))
        extra = ["single_purchased", "pkg_customized", "pkg_non_customized", "bogo_free_wash"]
    # S15+S16: the period spine is the union of the components' periods
    base = merge_on_key(comps, "day")
    base = base.fillna(0, subset=[c for c in COUNTS + extra if c != "sales_sar"])
    base = base.withColumn("sales_sar", to_dbl(F.coalesce("sales_sar", F.lit(0))))
    calc = base.select(
        F.col("day").alias("period"), "package_orders", "single_orders", "total_orders",
        pct("package_orders", "total_orders").alias("package_pct"),
        pct("single_orders", "total_orders").alias("single_pct"),
        "completed_washes", "washes_new_cust", "washes_returning_cust",
        pct("washes_returning_cust", "completed_washes").alias("returning_wash_pct"),
        rnd(ratio("completed_washes", "total_orders"), 2).alias("avg_washes_per_order"),
        "signups", "new_customers", pct("new_customers", "signups").alias("activation_pct"),
        "returning_customers", "active_customers",
        pct("returning_customers", "active_customers").alias("returning_pct"),
        "sales_sar", rnd(ratio("sales_sar", "total_orders"), 2).alias("aov"),
        rnd(ratio("total_orders", "active_customers"), 2).alias("aopu"),
        rnd(ratio("sales_sar", "active_customers"), 2).alias("arpu"),
        rnd(ratio("completed_washes", "washers_available"), 2).alias("washes_per_washer"),
        "washers_available", "purchased_orders", "avg_min_between_washes", *extra)
    if weekly:
        calc = calc.select(
            "*", rnd(ratio("assigned", "asg_washers"), 2).alias("assigned_per_washer"),
            rnd(ratio("executed", "exec_washers"), 2).alias("executed_per_washer"),
            rnd(ratio(ratio("executed", "exec_washers"), ratio("assigned", "asg_washers")), 2).alias("washer_efficiency"))
    return calc


# output order: (column, change kind) -- 'pct' = relative change, 'pts' = difference in points
SCOREBOARD_COLUMNS = [
    ("package_orders", "pct"), ("single_orders", "pct"), ("total_orders", "pct"), ("purchased_orders", "pct"),
    ("package_pct", "pts"), ("single_pct", "pts"), ("completed_washes", "pct"), ("washes_new_cust", "pct"),
    ("washes_returning_cust", "pct"), ("returning_wash_pct", "pts"), ("avg_washes_per_order", "pct"),
    ("signups", "pct"), ("new_customers", "pct"), ("activation_pct", "pts"), ("returning_customers", "pct"),
    ("active_customers", "pct"), ("returning_pct", "pts"), ("sales_sar", "pct"), ("aov", "pct"), ("aopu", "pct"),
    ("arpu", "pct"), ("washes_per_washer", "pct"), ("avg_min_between_washes", "pts"), ("washers_available", "pct"),
]
BREAKDOWN = ["single_purchased", "pkg_customized", "pkg_non_customized", "bogo_free_wash"]


def _with_changes(calc: DataFrame, suffix: str, breakdown: bool) -> DataFrame:
    """Every metric followed by its change against the previous present period.
    One LAG per metric (a single window over the per-period rows), then the changes."""
    w = Window.orderBy("period")
    lagged = calc.select("*", *[F.lag(n).over(w).alias(f"_prev_{n}") for n, _ in SCOREBOARD_COLUMNS])
    cols: list[Column] = [F.col("period")]
    for name, kind in SCOREBOARD_COLUMNS:
        x, prev = F.col(name), F.col(f"_prev_{name}")
        change = rnd(ratio((x - prev) * 100, prev), 1) if kind == "pct" else rnd(x - prev, 1)
        cols += [x, change.alias(f"{name}_{suffix}")]
        if breakdown and name == "purchased_orders":
            cols += [F.col(b) for b in BREAKDOWN]
    return lagged.select(*cols).orderBy(F.desc("period"))


def okr_scoreboard_daily(t: Tables, p: Params) -> DataFrame:
    """Month-to-date daily scoreboard with day-over-day changes, newest first."""
    return _with_changes(scoreboard_base(t, p, weekly=False, breakdown=False), "dod", False)


def okr_scoreboard_daily_breakdown(t: Tables, p: Params) -> DataFrame:
    """M55 plus single/package purchase breakdown columns."""
    return _with_changes(scoreboard_base(t, p, weekly=False, breakdown=True), "dod", True)


def okr_scoreboard_weekly(t: Tables, p: Params) -> DataFrame:
    """The scoreboard on anchored weeks with week-over-week changes."""
    return _with_changes(scoreboard_base(t, p, weekly=True, breakdown=False), "wow", False)


# Indicator rows of the weekly matrix (label, metric, multiplier).
MATRIX_INDICATORS = [
    ("01 sales", "sales_sar", 1), ("02 total orders", "total_orders", 1),
    ("03 purchased orders", "purchased_orders", 1), ("04 package orders", "package_orders", 1),
    ("05 single orders", "single_orders", 1), ("06 package share %", "package_pct", 1),
    ("07 single share %", "single_pct", 1), ("08 completed washes", "completed_washes", 1),
    ("09 washes of new customers", "washes_new_cust", 1), ("10 washes of returning customers", "washes_returning_cust", 1),
    ("11 returning washes %", "returning_wash_pct", 1), ("12 washes per order", "avg_washes_per_order", 1),
    ("13 signups", "signups", 1), ("14 new customers", "new_customers", 1), ("15 activation %", "activation_pct", 1),
    ("16 returning customers", "returning_customers", 1), ("17 active customers", "active_customers", 1),
    ("18 returning %", "returning_pct", 1), ("19 AOV", "aov", 1), ("20 AOPU", "aopu", 1), ("21 ARPU", "arpu", 1),
    ("22 washes per washer", "washes_per_washer", 1), ("23 minutes between washes", "avg_min_between_washes", 1),
    ("24 washers available", "washers_available", 1), ("25 assigned per washer", "assigned_per_washer", 1),
    ("26 executed per washer", "executed_per_washer", 1), ("27 washer efficiency %", "washer_efficiency", 100),
]


def okr_scoreboard_weekly_matrix(t: Tables, p: Params) -> DataFrame:
    """Indicators as rows x weeks as columns (S19 unpivot, S20 pivot on a fixed week list): ``Params.n_weeks``
    weeks from the anchor. Rows beyond the last of them are not read."""
    p = p.with_(as_of=min(p.today, p.anchor + dt.timedelta(days=7 * p.n_weeks)))
    calc = scoreboard_base(t, p, weekly=True, breakdown=False)
    # one type for all indicators, wide enough for any of them: a week's sales have up to 18 digits before the point
    vals = [((F.col(m) * mult) if mult != 1 else F.col(m)).cast("decimal(38,2)").alias(label)
            for label, m, mult in MATRIX_INDICATORS]
    long = calc.select("period", *vals).unpivot("period", [lbl for lbl, _, _ in MATRIX_INDICATORS], "indicator", "val")
    weeks = [w.isoformat() for w in p.weeks()]
    wide = long.groupBy("indicator").pivot("period", weeks).agg(F.max("val"))
    return wide.select("indicator", *[F.col(w).cast("double").alias(w) for w in weeks]).orderBy("indicator")


SCOREBOARD = {f.__name__: f for f in (okr_scoreboard_daily, okr_scoreboard_daily_breakdown, okr_scoreboard_weekly,
                                      okr_scoreboard_weekly_matrix)}
