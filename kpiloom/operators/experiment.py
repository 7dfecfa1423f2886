"""Region experiment (M51-M54): daily KPIs of a set of areas over the trailing 90 days.

CURDATE() is ``Params.today``; the window starts at today - 89 days and has no
upper bound (as in the source reports). M51 left-joins four daily aggregates to a
dense day spine generated from the parameters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import bsum, day, day_str, in_range, live, ratio, rnd, tod_wraps
from kpiloom.functions.windows import prev_gap_minutes
from kpiloom.params import Params
from kpiloom.sources.tables import Tables

# The late-night window of the experiment (wraps midnight).
LATE_NIGHT = ("22:30:00", "02:00:00")
SPAN_DAYS = 89


def _lo(p: Params) -> dt.date:
    return p.today - dt.timedelta(days=SPAN_DAYS)


def _scope(t: Tables, p: Params) -> DataFrame:
    return live(t.reservations).where((F.col("city_id") == p.city_id) & F.col("area_id").isin(list(p.area_ids)))


def _orders(t: Tables, p: Params) -> DataFrame:
    r = _scope(t, p).where(in_range("created_at", _lo(p)))
    return r.groupBy(day("created_at").alias("d")).agg(
        F.count(F.lit(1)).alias("total_orders"), bsum(F.col("use_package") == 0).alias("single_orders"),
        bsum(F.col("use_package") == 1).alias("package_orders"),
        bsum(tod_wraps("created_at", *LATE_NIGHT)).alias("late_night"),
        # cancelled orders (status 6) share the day key and filter: same pass
        F.count(F.when(F.col("status") == 6, 1)).alias("wasted"))


def _completed(t: Tables, p: Params) -> DataFrame:
    r = _scope(t, p).where((F.col("status") == 3) & in_range("representative_end_at", _lo(p)))
    return r.groupBy(day("representative_end_at").alias("d")).agg(
        F.count(F.lit(1)).alias("completed"), F.countDistinct("representative_id").alias("reps"))


def _orders_and_completed(t: Tables, p: Params) -> DataFrame:
    """``_orders`` and ``_completed`` from one scan: each reservation emits an order row (keyed by
    its creation day) and/or a completed row (keyed by its end day, with its worker). Fields of
    the other role are NULL, so every per-day SUM keeps the NULL rule of its own rows. Completed
    rows are first reduced per (day, worker), so counting those groups counts distinct workers
    (a NULL worker is not counted, as in COUNT(DISTINCT))."""
    lo = _lo(p)
    ordered, done = in_range("created_at", lo), (F.col("status") == 3) & in_range("representative_end_at", lo)
    null_int = lambda name: F.lit(None).cast("int").alias(name)
    as_order = F.struct(day("created_at").alias("d"), F.lit(None).cast("bigint").alias("rep"), F.lit(1).alias("o"),
                        (F.col("use_package") == 0).cast("int").alias("single"),
                        (F.col("use_package") == 1).cast("int").alias("package"),
                        tod_wraps("created_at", *LATE_NIGHT).cast("int").alias("late"),
                        (F.col("status") == 6).cast("int").alias("wasted"), null_int("c"))
    as_done = F.struct(day("representative_end_at").alias("d"), F.col("representative_id").alias("rep"),
                       null_int("o"), null_int("single"), null_int("package"), null_int("late"), null_int("wasted"),
                       F.lit(1).alias("c"))
    tagged = F.array(F.when(ordered, as_order), F.when(done, as_done))
    rows = _scope(t, p).where(ordered | done).select(F.inline(F.filter(tagged, lambda x: x.isNotNull())))
    per_rep = rows.groupBy("d", "rep").agg(
        F.sum("o").alias("o"), F.sum("single").alias("single"), F.sum("package").alias("package"),
        F.sum("late").alias("late"), F.count(F.when(F.col("wasted") == 1, 1)).alias("wasted"),
        F.sum("c").alias("c"))
    return per_rep.groupBy("d").agg(
        F.sum("o").alias("total_orders"), F.sum("single").alias("single_orders"),
        F.sum("package").alias("package_orders"), F.sum("late").alias("late_night"),
        F.sum("wasted").alias("wasted"), F.sum("c").alias("completed"),
        F.count(F.when(F.col("rep").isNotNull() & (F.col("c") > 0), 1)).alias("reps"))


def _transit(t: Tables, p: Params) -> DataFrame:
    """Minutes from a worker's previous job end to this job's start, same worker and day."""
    r = _scope(t, p).where((F.col("status") == 3) & in_range("representative_start_at", _lo(p))
                           & F.col("representative_id").isNotNull())
    r = r.select("representative_id", "representative_start_at", "representative_end_at",
                 day("representative_start_at").alias("d"))
    g = prev_gap_minutes(r, ["representative_id", "d"], "representative_start_at", "representative_end_at")
    g = g.where(F.col("gap").between(0, p.max_gap_minutes))
    return g.groupBy("d").agg(rnd(ratio(F.sum("gap"), F.count("gap")), 1).alias("avg_transit"))


def _spine(t: Tables, p: Params) -> DataFrame:
    spark = t.reservations.sparkSession
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(_lo(p)), F.lit(p.today), F.expr("INTERVAL 1 DAY"))).alias("d"))


def experiment_daily(t: Tables, p: Params) -> DataFrame:
    """M51"""
    s = _spine(t, p)
    j = s.join(_orders_and_completed(t, p), "d", "left").join(_transit(t, p), "d", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select(
        day_str("d").alias("day"), z("completed"), z("wasted"), F.col("avg_transit").alias("avg_transit_min"),
        rnd(ratio("completed", "reps"), 2).alias("washes_per_rep"), z("late_night").alias("late_night_orders"),
        z("total_orders"), z("single_orders"), z("package_orders"),
    ).orderBy(F.desc("day"))


def experiment_orders(t: Tables, p: Params) -> DataFrame:
    """M52"""
    return (_orders(t, p).select(F.col("d").alias("day"), "single_orders", "package_orders").orderBy("day"))


def experiment_completed(t: Tables, p: Params) -> DataFrame:
    """M53"""
    return _completed(t, p).select(F.col("d").alias("day"), "completed").orderBy("day")


def experiment_per_rep(t: Tables, p: Params) -> DataFrame:
    """M54"""
    return (_completed(t, p).select(F.col("d").alias("day"), rnd(ratio("completed", "reps"), 2).alias("washes_per_rep"))
            .orderBy("day"))


EXPERIMENT = {f.__name__: f for f in (experiment_daily, experiment_orders, experiment_completed, experiment_per_rep)}
