"""Distinct counts of any period from stored days.

A distinct count of a month is not the sum of its days'. What adds up are sets. ``write_sets`` stores, for each
metric and day, the set of its ids in one of two forms:

- bitmaps, exact: ids are dealt to buckets of 32,768 and a day has one bitmap of 4 KB for each bucket that it
  hits. Weeks, months and any range are the OR of their days, bucket by bucket, and a count of bits. Ids may be any
  64-bit numbers; bitmaps pay where ids are dense, as counters are (an id alone in its bucket costs 4 KB before
  compression).
- theta sketches, approximate: one sketch for each day, whatever the ids. Unions give ranges and differences give
  new against returning. With 2^k entries the relative standard error of a count is about 1 / sqrt(2^k), 0.8 % for
  the default 14, and counts up to 2^k are exact.

Facts are read once, when a day is stored; ``write_sets`` with months replaces those months only.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import day_str, live, month_start, ratio, rnd, week_start, week_str
from kpiloom.operators.activity import first_activity_rows
from kpiloom.operators.segments import indiv_rows
from kpiloom.params import Params
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables

LG_ENTRIES = 14


def _present(t: Tables, p: Params) -> DataFrame:
    return t.attendances.select(F.col("date").alias("day"), F.col("representative_id").alias("id"))


def _executing(t: Tables, p: Params) -> DataFrame:
    done = live(t.reservations).where((F.col("status") == 3) & F.col("representative_id").isNotNull())
    return done.select(F.to_date("created_at").alias("day"), F.col("representative_id").alias("id"))


def _washed(t: Tables, p: Params) -> DataFrame:
    done = live(t.reservations).where(F.col("status") == 3)
    return done.select(F.try_to_date("date").alias("day"), F.col("representative_id").alias("id"))


def _active(t: Tables, p: Params) -> DataFrame:
    return first_activity_rows(t).select(F.try_to_date("act").alias("day"), F.col("client_id").alias("id"))


def _individuals(t: Tables, p: Params) -> DataFrame:
    return indiv_rows(t, p).select(F.to_date("created_at").alias("day"), F.col("client_id").alias("id"))


#: Metric -> (day, id) rows: workers present (S09), workers of completed orders by creation day (M19, M20) and by service
#: day (M60), clients with an order unit (S06), individual customers with an order.
SETS: dict[str, Callable[[Tables, Params], DataFrame]] = {
    "present": _present, "executing": _executing, "washed": _washed, "active": _active, "individuals": _individuals}


def day_bitmaps(rows: DataFrame) -> DataFrame:
    """(day, bucket, n, bits): rows and the bitmap of ids of each day and bucket. Rows without an id count in ``n`` under
    a NULL bucket; rows without a day are left out.

    Spark sorts the input of bitmap aggregates, so equal (day, id) rows are counted first, in a hash aggregate."""
    pairs = rows.where(F.col("day").isNotNull()).groupBy(F.col("day").cast("date").alias("day"), "id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("day", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.sum("n").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def day_sketches(rows: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(day, n, sketch): rows and the theta sketch of ids of each day."""
    return rows.where(F.col("day").isNotNull()).groupBy(F.col("day").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg("id", F.lit(lg_entries)).alias("sketch"))


def write_sets(t: Tables, p: Params, root: str, names: Iterable[str] = tuple(SETS), *, sketches: bool = False,
               months: Iterable[str] | None = None) -> str:
    """Store the days of ``names`` under ``root``, by metric and month ('YYYY-MM'). ``months``: only these, replacing what
    is stored of them and leaving the other months' files alone."""
    for name in names:
        rows = SETS[name](t, p)
        if months is not None:
            rows = rows.where(F.date_format("day", "yyyy-MM").isin(list(months)))
        days = day_sketches(rows) if sketches else day_bitmaps(rows)
        (days.withColumn("metric", F.lit(name)).withColumn("month", F.date_format("day", "yyyy-MM"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "month").parquet(root))
    return root


def read_days(spark, root: str, name: str, lo: dt.date | None = None, hi: dt.date | None = None) -> DataFrame:
    """The stored days [lo, hi) of a metric; months outside are not read."""
    days = spark.read.option("basePath", root).parquet(f"{root}/metric={name}").drop("metric")
    month = F.col("month").cast("string")
    if lo is not None:
        days = days.where((month >= f"{lo:%Y-%m}") & (F.col("day") >= F.lit(lo)))
    if hi is not None:
        days = days.where((month <= f"{hi:%Y-%m}") & (F.col("day") < F.lit(hi)))
    return days


def rolled_up(days: DataFrame, period: Column) -> DataFrame:
    """(period, n, ids, days): rows, exact distinct ids and days with rows of each period of ``day``."""
    sets = days.withColumn("period", period)
    dates = sets.groupBy("period").agg(F.countDistinct("day").alias("days"))
    merged = sets.groupBy("period", "bucket").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("period").agg(F.sum("n").alias("n"), F.sum(F.bitmap_count("bits")).alias("ids")).join(dates, "period")


def sketched(days: DataFrame, period: Column, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(period, n, sketch) of each period of ``day``. A union keeps 2^``lg_entries`` entries too."""
    return days.groupBy(period.alias("period")).agg(
        F.sum("n").alias("n"), F.theta_union_agg("sketch", F.lit(lg_entries)).alias("sketch"))


def new_against_returning(days: DataFrame, period: Column, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(period, new, returning): ids that no earlier stored period has, and the others, by differences of sketches. The
    running union is over one row for each period."""
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rows = sketched(days, period, lg_entries).withColumn("before", F.theta_union_agg("sketch", F.lit(lg_entries)).over(before))
    seen = F.theta_sketch_estimate("sketch")
    new = F.when(F.col("before").isNull(), seen).otherwise(F.theta_sketch_estimate(F.theta_difference("sketch", "before")))
    return rows.select("period", new.cast("bigint").alias("new"), (seen - new).cast("bigint").alias("returning"))


# ---- reports from stored days: they write the days they need into a new folder first
def _stored(t: Tables, p: Params, *names: str, sketches: bool = False) -> str:
    base = ensure_checkpoint_dir(t.attendances.sparkSession).rstrip("/")
    return write_sets(t, p, f"{base}/kpiloom-sets-{uuid.uuid4().hex}", names, sketches=sketches)


def _spark(t: Tables):
    return t.attendances.sparkSession


def workers_present_bitmap(t: Tables, p: Params) -> DataFrame:
    """S09 by day, month to date."""
    days = read_days(_spark(t), _stored(t, p, "present"), "present", p.month_start, p.today)
    return rolled_up(days, day_str("day")).select("period", F.col("ids").alias("washers_available")).orderBy("period")


def workers_present_weekly_bitmap(t: Tables, p: Params) -> DataFrame:
    """S09 by anchored week."""
    days = read_days(_spark(t), _stored(t, p, "present"), "present", p.anchor, p.today)
    return rolled_up(days, week_str("day", p.anchor)).select("period", F.col("ids").alias("washers_available")).orderBy("period")


def per_washer_daily_bitmap(t: Tables, p: Params) -> DataFrame:
    """M20."""
    days = read_days(_spark(t), _stored(t, p, "executing"), "executing", p.date_from, p.date_to)
    return rolled_up(days, F.col("day")).select(F.col("period").alias("day"), rnd(ratio("n", "ids"), 2).alias("per_washer")).orderBy("day")


def per_washer_per_day_bitmap(t: Tables, p: Params) -> DataFrame:
    """M19."""
    days = read_days(_spark(t), _stored(t, p, "executing"), "executing", p.date_from, p.date_to)
    return rolled_up(days, month_start("day")).select(
        F.col("period").alias("month"), rnd(ratio("n", F.col("ids") * F.col("days")), 2).alias("per_washer_per_day")).orderBy("month")


def north_star_per_week_bitmap(t: Tables, p: Params) -> DataFrame:
    """M60."""
    root, week = _stored(t, p, "present", "washed"), week_start("day", p.anchor)
    washes = rolled_up(read_days(_spark(t), root, "washed", p.anchor, p.today), week).select("period", F.col("n").alias("washes"))
    washers = rolled_up(read_days(_spark(t), root, "present", p.anchor, p.today), week).select("period", "ids")
    return washes.join(washers, "period").select(
        F.col("period").alias("week_start"), rnd(ratio("washes", "ids"), 2).alias("washes_per_washer_week")).orderBy("week_start")


def active_customers_weekly_bitmap(t: Tables, p: Params) -> DataFrame:
    """S06 active customers by anchored week."""
    days = read_days(_spark(t), _stored(t, p, "active"), "active", p.anchor, p.today)
    return rolled_up(days, week_str("day", p.anchor)).select("period", F.col("ids").alias("active_customers")).orderBy("period")


def indiv_new_vs_returning_sketch(t: Tables, p: Params) -> DataFrame:
    """M43 from sketches: exact up to 16,384 clients, then within the error stated above."""
    days = read_days(_spark(t), _stored(t, p, "individuals", sketches=True), "individuals")
    return new_against_returning(days, month_start("day")).select(
        F.col("period").alias("month"), F.col("new").alias("new_customers"), F.col("returning").alias("returning_customers")).orderBy("month")


FROM_SETS = {f.__name__: f for f in (
    workers_present_bitmap, workers_present_weekly_bitmap, per_washer_daily_bitmap, per_washer_per_day_bitmap,
    north_star_per_week_bitmap, active_customers_weekly_bitmap, indiv_new_vs_returning_sketch)}
