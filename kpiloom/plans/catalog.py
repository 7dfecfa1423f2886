"""Registry of the report queries: operator + parameters + test-table binding + oracle SQL.

``QUERIES`` feeds ``__spark_entry__.queries()``/``oracle_sql()``, the tests and the bench.
Every query reads the whole derived test tables (no id subsets, no row caps); only the
report's own semantics (date ranges, segments, a top-k) restrict rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from kpiloom.oracle.views import with_views
from kpiloom.params import FIXTURE, Params
from kpiloom.sources.tables import Tables, derive_test_tables


@dataclass(frozen=True)
class Query:
    name: str
    op: Callable[[Tables, Params], DataFrame]
    params: Params = FIXTURE
    # serve the long order history (80 months) as ``reservations``
    long_history: bool = False
    oracle: Callable[[Params], str] | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)
    # derive a ``b2b_accounts`` segment table (clients in Params.b2b_ids) instead of the literal list
    segment_table: bool = False

    def tables(self, spark: SparkSession, sf_dir: str) -> Tables:
        t = derive_test_tables(spark, sf_dir)
        if self.long_history:
            t = t.replace(reservations=t.reservations_long)
        if self.segment_table:
            from pyspark.sql import functions as F

            t = t.replace(b2b_accounts=t.clients.where(F.col("id").isin(list(self.params.b2b_ids))).select("id"))
        return t

    # streaming queries take (spark, sf_dir, params) and read their own file stream
    streaming: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.streaming:
            return self.op(spark, sf_dir, self.params)
        return self.op(self.tables(spark, sf_dir), self.params)

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        alias = {"reservations": "reservations_long"} if self.long_history else None
        return with_views(self.oracle(self.params), alias)


QUERIES: dict[str, Query] = {}


def register(q: Query) -> Query:
    if q.name in QUERIES:
        raise ValueError(f"duplicate query {q.name}")
    QUERIES[q.name] = q
    return q


# ----------------------------------------------------------------------------- growth
def _growth() -> None:
    from kpiloom.operators.growth import GROWTH
    from kpiloom.oracle.growth import GROWTH_SQL

    needs_events = {"growth_time_to_consume"}
    for name, op in GROWTH.items():
        for grain in ("daily", "cumulative", "monthly"):
            long_history = grain == "monthly" and name not in needs_events
            register(Query(f"{name}_{grain}", op, FIXTURE.with_(grain=grain), long_history,
                           GROWTH_SQL[name], ("growth",)))
    rng = dict(date_from=dt.date(2024, 1, 8), date_to=dt.date(2024, 1, 22))
    for name in ("growth_package_orders", "growth_single_orders", "growth_washes_per_order", "growth_aov", "growth_completed",
                 "growth_orders"):
        register(Query(f"{name}_daily_range", GROWTH[name], FIXTURE.with_(grain="daily", **rng),
                       False, GROWTH_SQL[name], ("growth",)))
    register(Query("growth_washes_per_order_cumulative_range", GROWTH["growth_washes_per_order"],
                   FIXTURE.with_(grain="cumulative", **rng), False, GROWTH_SQL["growth_washes_per_order"], ("growth",)))
    for name in ("growth_sales", "growth_repeat", "growth_aopu", "growth_time_to_consume"):
        register(Query(f"{name}_cumulative_range", GROWTH[name], FIXTURE.with_(grain="cumulative", **rng),
                       False, GROWTH_SQL[name], ("growth",)))
    register(Query("growth_orders_weekly", GROWTH["growth_orders"], FIXTURE.with_(grain="weekly"), False,
                   GROWTH_SQL["growth_orders"], ("growth",)))


_growth()


# ----------------------------------------------------------------------------- OKR cards
def _okr() -> None:
    from kpiloom.operators.okr import OKR
    from kpiloom.oracle.okr import OKR_SQL

    # reservation cards read the 80-month history for the monthly grain
    long_ok = {"okr_sales", "okr_orders", "okr_package_share", "okr_single_share", "okr_aov", "okr_completed",
               "okr_completed_from_packages"}
    daily_range = dict(grain="daily", date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 26))
    for name, op in OKR.items():
        if name == "sales_last_n_days":
            register(Query(name, op, FIXTURE, False, OKR_SQL[name], ("okr",)))
            continue
        if name != "okr_per_washer_daily":
            register(Query(f"{name}_monthly", op, FIXTURE.with_(grain="monthly"), name in long_ok, OKR_SQL[name],
                           ("okr",)))
        if name != "okr_per_washer_per_day":
            qname = name if name.endswith("_daily") else f"{name}_daily"
            register(Query(qname, op, FIXTURE.with_(**daily_range), False, OKR_SQL[name], ("okr",)))


_okr()


# ----------------------------------------------------------------------------- boards
def _boards() -> None:
    from kpiloom.oracle.okr import board
    from kpiloom.plans.board import okr_board_long

    rng = dict(date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 26))
    register(Query("okr_board_monthly", okr_board_long, FIXTURE.with_(grain="monthly"), False, board, ("board",)))
    register(Query("okr_board_daily", okr_board_long, FIXTURE.with_(grain="daily", **rng), False, board, ("board",)))


_boards()


# ----------------------------------------------------------------------------- segments
def _segments() -> None:
    from kpiloom.operators.segments import SEGMENTS
    from kpiloom.oracle.segments import SEGMENTS_SQL

    monthly_long = {"indiv_monthly_washes", "indiv_monthly_revenue", "indiv_new_vs_returning", "indiv_repeat_trend",
                    "indiv_order_histogram"}
    for name, op in SEGMENTS.items():
        register(Query(name, op, FIXTURE, name in monthly_long, SEGMENTS_SQL[name], ("segments",)))
    acct = FIXTURE.with_(account="Customer#000000007")
    for name in ("b2b_washes", "b2b_account_table", "b2b_monthly_revenue"):
        register(Query(f"{name}_account", SEGMENTS[name], acct, False, SEGMENTS_SQL[name], ("segments",)))
    for name in ("b2b_account_table", "indiv_repeat_rate", "daily_segment_orders", "daily_completed_by_segment"):
        register(Query(f"{name}_segment_table", SEGMENTS[name], FIXTURE, False, SEGMENTS_SQL[name], ("segments",),
                       segment_table=True))
    ci = FIXTURE.with_(account="CUSTOMER#000000011", ci_text=True)
    register(Query("b2b_washes_account_ci", SEGMENTS["b2b_washes"], ci, False, SEGMENTS_SQL["b2b_washes"],
                   ("segments",)))


_segments()


# ----------------------------------------------------------------------------- geo + experiment
def _geo_experiment() -> None:
    from kpiloom.operators.experiment import EXPERIMENT
    from kpiloom.operators.geo import orders_by_area
    from kpiloom.oracle.geo_experiment import EXPERIMENT_SQL, GEO_SQL

    register(Query("orders_by_area", orders_by_area, FIXTURE, False, GEO_SQL["orders_by_area"], ("geo",)))
    register(Query("orders_by_area_range", orders_by_area,
                   FIXTURE.with_(date_from=dt.date(2024, 1, 10), date_to=dt.date(2024, 1, 20)), False,
                   GEO_SQL["orders_by_area"], ("geo",)))
    register(Query("orders_by_area_month", orders_by_area, FIXTURE.with_(month="2024-01"), False,
                   GEO_SQL["orders_by_area"], ("geo",)))
    for name, op in EXPERIMENT.items():
        register(Query(name, op, FIXTURE, False, EXPERIMENT_SQL[name], ("experiment",)))


_geo_experiment()


# ----------------------------------------------------------------------------- weekly
def _weekly() -> None:
    from kpiloom.operators.weekly import WEEKLY
    from kpiloom.oracle.weekly import WEEKLY_SQL

    for name, op in WEEKLY.items():
        register(Query(name, op, FIXTURE, name == "monthly_paid_washes", WEEKLY_SQL[name], ("weekly",)))


_weekly()


# ----------------------------------------------------------------------------- scoreboards
def _scoreboards() -> None:
    from kpiloom.operators.scoreboard import SCOREBOARD
    from kpiloom.oracle.scoreboard import SCOREBOARD_SQL

    for name, op in SCOREBOARD.items():
        register(Query(name, op, FIXTURE, False, SCOREBOARD_SQL[name], ("scoreboard",)))


_scoreboards()


# ----------------------------------------------------------------------------- column profile
def _profile() -> None:
    from kpiloom.operators.profile import PROFILE
    from kpiloom.oracle.profile import PROFILE_SQL

    register(Query("profile_columns", PROFILE["profile_columns"], FIXTURE, True, PROFILE_SQL["profile_columns"],
                   ("profile",)))
    register(Query("profile_columns_sketch", PROFILE["profile_columns_sketch"], FIXTURE, True,
                   PROFILE_SQL["profile_columns_sketch"], ("profile",)))
    # approximate by design: tests/test_profile.py holds it against the exact profile within the stated errors
    register(Query("profile_reservations_sketch", PROFILE["profile_reservations_sketch"], FIXTURE, False, None, ("profile",)))


_profile()


# ----------------------------------------------------------------------------- streaming forms
def _streaming() -> None:
    from kpiloom.oracle.growth import GROWTH_SQL
    from kpiloom.oracle.weekly import WEEKLY_SQL
    from kpiloom.streaming.weekly import stream_daily_orders, stream_weekly_paid_washes

    register(Query("stream_weekly_paid_washes", stream_weekly_paid_washes, FIXTURE, False,
                   WEEKLY_SQL["weekly_paid_washes"], ("streaming",), streaming=True))
    register(Query("stream_growth_orders_daily", stream_daily_orders, FIXTURE.with_(grain="daily"), False,
                   GROWTH_SQL["growth_orders"], ("streaming",), streaming=True))
    from kpiloom.oracle.common import d
    from kpiloom.streaming.event_time import stream_daily_orders_final, stream_weekly_washes_final

    def closed(sql: str, key: str, days: int, lo: str) -> str:
        """The periods that end at least a day before the newest row that is read."""
        return (f"SELECT * FROM ({sql}) t WHERE {key} + {days} <= "
                f"(SELECT max(created_at) - INTERVAL 1 DAY FROM reservations WHERE deleted_at IS NULL AND created_at >= {lo}) ORDER BY {key}")

    register(Query("stream_weekly_washes_final", stream_weekly_washes_final, FIXTURE, False,
                   lambda p: closed(WEEKLY_SQL["weekly_paid_washes"](p), "week_start", 7, d(p.anchor)), ("streaming",), streaming=True))
    register(Query("stream_daily_orders_final", stream_daily_orders_final, FIXTURE.with_(grain="daily"), False,
                   lambda p: closed(GROWTH_SQL["growth_orders"](p), "period", 1, "DATE '1900-01-01'"), ("streaming",), streaming=True))


_streaming()


# ----------------------------------------------------------------------------- bounds that cut rows
def _bounds() -> None:
    """Parameters under which each bound removes rows of the test tables, so that a check fails without it."""
    early = dict(as_of=dt.date(2024, 1, 20), anchor=dt.date(2024, 1, 10))
    for name in ("okr_scoreboard_daily", "okr_scoreboard_daily_breakdown", "okr_scoreboard_weekly",
                 "okr_scoreboard_weekly_matrix", "north_star_weighted", "north_star_per_week", "weekly_paid_washes",
                 "weekly_purchase_breakdown", "weekly_worker_efficiency", "weekly_assignment_efficiency"):
        register(replace(QUERIES[name], name=f"{name}_early", params=FIXTURE.with_(**early)))
    for name in ("sales_last_n_days", "daily_segment_table", "daily_completed_by_segment", "daily_purchase_breakdown"):
        register(replace(QUERIES[name], name=f"{name}_7", params=FIXTURE.with_(as_of=dt.date(2024, 1, 20), last_days=7)))
    for name in ("experiment_daily", "experiment_orders", "experiment_completed", "experiment_per_rep"):
        register(replace(QUERIES[name], name=f"{name}_span", params=FIXTURE.with_(as_of=dt.date(2024, 4, 10))))


_bounds()


# ----------------------------------------------------------------------------- first activity by increments
def _activity() -> None:
    from kpiloom.oracle.activity import first_activity
    from kpiloom.oracle.scoreboard import SCOREBOARD_SQL
    from kpiloom.plans.activity_queries import FROM_STORE, first_activity_incremental

    register(Query("first_activity_incremental", first_activity_incremental, FIXTURE, False, first_activity, ("activity",)))
    for name, op in FROM_STORE.items():
        register(Query(name, op, FIXTURE, False, SCOREBOARD_SQL[name.removesuffix("_incremental")], ("scoreboard",)))


_activity()


# ----------------------------------------------------------------------------- bucketed layout
def _layout() -> None:
    from kpiloom.oracle.activity import customers
    from kpiloom.oracle.growth import GROWTH_SQL
    from kpiloom.plans.layout import BUCKETED

    register(Query("washes_per_order_bucketed", BUCKETED["washes_per_order_bucketed"], FIXTURE, False,
                   GROWTH_SQL["growth_washes_per_order"], ("layout",)))
    register(Query("customers_daily_bucketed", BUCKETED["customers_daily_bucketed"], FIXTURE, False,
                   lambda p: customers(p, False), ("layout",)))
    register(Query("customers_weekly_bucketed", BUCKETED["customers_weekly_bucketed"], FIXTURE, False,
                   lambda p: customers(p, True), ("layout",)))


_layout()


# ----------------------------------------------------------------------------- distinct counts from stored days
def _distinct() -> None:
    from kpiloom.oracle import distinct
    from kpiloom.oracle.okr import OKR_SQL
    from kpiloom.oracle.segments import SEGMENTS_SQL
    from kpiloom.oracle.weekly import WEEKLY_SQL
    from kpiloom.plans.distinct_store import FROM_SETS

    rng = FIXTURE.with_(grain="daily", date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 26))
    for name, params, long_history, sql in (
            ("workers_present_bitmap", FIXTURE, False, distinct.workers_present),
            ("workers_present_weekly_bitmap", FIXTURE, False, distinct.workers_present_weekly),
            ("per_washer_daily_bitmap", rng, False, OKR_SQL["okr_per_washer_daily"]),
            ("per_washer_per_day_bitmap", FIXTURE.with_(grain="monthly"), False, OKR_SQL["okr_per_washer_per_day"]),
            ("north_star_per_week_bitmap", FIXTURE, False, WEEKLY_SQL["north_star_per_week"]),
            ("active_customers_weekly_bitmap", FIXTURE, False, distinct.active_customers_weekly),
            ("indiv_new_vs_returning_sketch", FIXTURE, True, SEGMENTS_SQL["indiv_new_vs_returning"])):
        register(Query(name, FROM_SETS[name], params, long_history, sql, ("distinct",)))


_distinct()


# ----------------------------------------------------------------------------- SQL surface
def _sql_surface() -> None:
    from kpiloom.oracle.growth import GROWTH_SQL
    from kpiloom.plans.sql_surface import growth_orders_via_sql

    register(Query("sql_growth_orders_weekly_range", growth_orders_via_sql,
                   FIXTURE.with_(grain="weekly", date_from=dt.date(2024, 1, 3), date_to=dt.date(2024, 1, 27)),
                   False, GROWTH_SQL["growth_orders"], ("sql",)))
    register(Query("sql_growth_orders_cumulative", growth_orders_via_sql, FIXTURE.with_(grain="cumulative"),
                   False, GROWTH_SQL["growth_orders"], ("sql",)))


_sql_surface()


# ----------------------------------------------------------------------------- SQL table functions
def _sql_functions() -> None:
    from kpiloom.oracle.growth import GROWTH_SQL
    from kpiloom.oracle.segments import SEGMENTS_SQL
    from kpiloom.plans.sql_functions import ACCOUNTS, GROWTH, call

    rng = dict(date_from=dt.date(2024, 1, 3), date_to=dt.date(2024, 1, 27))
    for name in GROWTH:
        for suffix, params in (("cumulative", FIXTURE.with_(grain="cumulative")),
                               ("weekly_range", FIXTURE.with_(grain="weekly", **rng))):
            if f"sql_{name}_{suffix}" not in QUERIES:
                register(Query(f"sql_{name}_{suffix}", call(name), params, False, GROWTH_SQL[name], ("sql",)))
        if name != "growth_washes_per_order" and name != "growth_time_to_consume":
            register(Query(f"sql_{name}_monthly", call(name), FIXTURE.with_(grain="monthly"), False, GROWTH_SQL[name], ("sql",)))
    for name in ACCOUNTS:
        register(Query(f"sql_{name}", call(name), FIXTURE, False, SEGMENTS_SQL[name], ("sql",)))
        register(Query(f"sql_{name}_account", call(name), FIXTURE.with_(account="Customer#000000007"), False,
                       SEGMENTS_SQL[name], ("sql",)))


_sql_functions()


# ----------------------------------------------------------------------------- relative dates
def _dates() -> None:
    from kpiloom.operators.growth import GROWTH
    from kpiloom.operators.okr import OKR
    from kpiloom.oracle.growth import GROWTH_SQL
    from kpiloom.oracle.okr import OKR_SQL

    clock = FIXTURE.with_(as_of=dt.date(2024, 1, 24))
    for name, op, sql, option in (("growth_orders", GROWTH, GROWTH_SQL, "past 10 days"),
                                  ("growth_repeat", GROWTH, GROWTH_SQL, "past 2 weeks including this week"),
                                  ("growth_sales", GROWTH, GROWTH_SQL, "until 2024-01-15"),
                                  ("okr_sales", OKR, OKR_SQL, "previous week"),
                                  ("okr_csat", OKR, OKR_SQL, "since 2024-01-20"),
                                  ("okr_completed", OKR, OKR_SQL, "this quarter")):
        register(Query(f"{name}_{option.replace(' ', '_').replace('-', '_')}", op[name], clock.dated(option), False, sql[name], ("dates",)))


_dates()


# ----------------------------------------------------------------------------- stored reports, bounds as a table
def _stored() -> None:
    from kpiloom.oracle.growth import GROWTH_SQL
    from kpiloom.oracle.okr import OKR_SQL
    from kpiloom.plans.board import growth_orders_stored
    from kpiloom.plans.monthly import orders_within_bounds, sales_within_bounds

    register(Query("growth_orders_stored", growth_orders_stored, FIXTURE.with_(grain="daily"), True, GROWTH_SQL["growth_orders"], ("stored",)))
    rng = dict(date_from=dt.date(1995, 5, 20), date_to=dt.date(1996, 2, 3))
    register(Query("orders_within_bounds", orders_within_bounds, FIXTURE.with_(grain="daily", **rng), True, OKR_SQL["okr_orders"], ("bounds",)))
    register(Query("sales_within_bounds", sales_within_bounds, FIXTURE.with_(grain="monthly", **rng), True, OKR_SQL["okr_sales"], ("bounds",)))


_stored()
