"""Column profile of a result (M66): the per-column statistics a BI tool caches with a
report result (distinct count, nil %, date range, numeric moments and quartiles,
mode and top-3 fractions).

One UNPIVOT turns the result into (column, value) rows, so every statistic is a
grouped aggregate keyed by column name: partial aggregation on the map side, one
shuffle, no driver loop over columns. Top-3 frequencies use ``row_number() <= 3``
over value counts, which Spark plans as a window group limit: each task keeps at
most three values per column before the shuffle, whatever the cardinality.
Quartiles use bounded-memory ``percentile_approx`` by default: an exact ``percentile``
keeps a value -> count map per column in one task, which grows with the input. Callers
whose input is bounded by construction (a report result: one row per period) pass
``exact_quantiles=True``, as the registered M66 query does.

``profile_sketched`` is the form for fact tables: the table is read once, every statistic of every column comes from
one aggregate, and what a task holds of a column does not grow with the table. Distinct counts are theta sketches
(exact up to 2^14 values, then a relative standard error of 0.8 %), quartiles KLL sketches (rank error below 0.15 % at
k = 4096, with 99 % confidence), and the most frequent values space-saving counters (exact while no more than 0.75 *
10,000 values are tracked; beyond, a count is off by at most about rows / 2,800).
Statistics are rounded to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import ratio, rnd
from kpiloom.params import Params
from kpiloom.sources.tables import Tables

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC):
        return "number"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    return "text"


def profile_frame(df: DataFrame, exact_quantiles: bool = False) -> DataFrame:
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    cols = list(kinds)
    text = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    base = text.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nn"),
                                      F.countDistinct("v").alias("distinct_count"))
    freq = text.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    rk = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("v")))
    top = (freq.withColumn("rk", rk).where(F.col("rk") <= 3).groupBy("column")
           .agg(F.max(F.when(F.col("rk") == 1, F.col("cnt"))).alias("top1"), F.sum("cnt").alias("top3")))
    out = base.join(top, "column", "left")

    nums = [c for c in cols if kinds[c] == "number"]
    if nums:
        long = df.select([F.col(c).cast("double").alias(c) for c in nums]).unpivot([], nums, "column", "x")
        x = F.col("x")
        q = ((F.percentile(x, F.lit(0.25)), F.percentile(x, F.lit(0.75))) if exact_quantiles
             else (F.percentile_approx(x, 0.25, 10000), F.percentile_approx(x, 0.75, 10000)))
        num = long.groupBy("column").agg(
            F.min(x).alias("min"), q[0].alias("q1"), q[1].alias("q3"), F.max(x).alias("max"),
            F.avg(x).alias("avg"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skewness"),
            F.kurtosis(x).alias("excess_kurtosis"), F.count(F.when(x == 0, 1)).alias("zeros"))
        out = out.join(num, "column", "left")
    dates = [c for c in cols if kinds[c] == "datetime"]
    if dates:
        long = df.select([F.col(c).cast("timestamp").alias(c) for c in dates]).unpivot([], dates, "column", "t")
        dt_ = long.groupBy("column").agg(F.date_format(F.min("t"), "yyyy-MM-dd").alias("earliest"),
                                         F.date_format(F.max("t"), "yyyy-MM-dd").alias("latest"))
        out = out.join(dt_, "column", "left")
    kind_map = F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(kinds[c]))])
    opt = lambda c, t: F.col(c) if c in out.columns else F.lit(None).cast(t)
    r6 = lambda c: rnd(opt(c, "double"), 6)
    return out.select(
        "column", kind_map[F.col("column")].alias("kind"), "distinct_count",
        rnd(ratio(F.col("n") - F.col("nn"), "n"), 6).alias("nil_pct"),
        opt("earliest", "string").alias("earliest"), opt("latest", "string").alias("latest"),
        r6("min").alias("min"), r6("q1").alias("q1"), r6("q3").alias("q3"), r6("max").alias("max"),
        r6("avg").alias("avg"), r6("sd").alias("sd"), r6("skewness").alias("skewness"),
        r6("excess_kurtosis").alias("excess_kurtosis"),
        rnd(ratio(opt("zeros", "bigint"), "n"), 6).alias("zero_fraction"),
        rnd(ratio("top1", "n"), 6).alias("mode_fraction"), rnd(ratio("top3", "n"), 6).alias("top3_fraction"),
    ).orderBy("column")


KLL_K = 4096
TRACKED = 10_000
LG_ENTRIES = 14


def profile_sketched(df: DataFrame, kll_k: int = KLL_K, tracked: int = TRACKED, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """The columns of ``profile_frame`` from one pass over ``df``, with bounded errors in place of exact quartiles,
    distinct counts and frequencies. Where no value is more frequent than the counters' error, as in a column of
    unique ids, the two fractions are NULL."""
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    values = [F.struct(
        F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"),
        (F.col(f"`{c}`").cast("double") if k == "number" else F.lit(None).cast("double")).alias("x"),
        (F.col(f"`{c}`").cast("timestamp") if k == "datetime" else F.lit(None).cast("timestamp")).alias("t"))
        for c, k in kinds.items()]
    long = df.select(F.inline(F.array(*values)))
    x = F.col("x")
    id_ = F.concat(F.lit("="), F.col("v"))  # the sketch passes over empty text
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("nn"), F.theta_sketch_agg(id_, F.lit(lg_entries)).alias("ids"),
        F.expr(f"approx_top_k(v, 4, {tracked})").alias("top"),
        F.min(x).alias("min"), F.expr(f"kll_sketch_agg_double(x, {kll_k})").alias("ranks"), F.max(x).alias("max"),
        F.avg(x).alias("avg"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("excess_kurtosis"), F.count(F.when(x == 0, 1)).alias("zeros"),
        F.date_format(F.min("t"), "yyyy-MM-dd").alias("earliest"), F.date_format(F.max("t"), "yyyy-MM-dd").alias("latest"))
    kind = F.create_map(*[v for c, k in kinds.items() for v in (F.lit(c), F.lit(k))])[F.col("column")]
    # NULL may be among the items
    top = F.slice(F.transform(F.filter("top", lambda r: r["item"].isNotNull()), lambda r: r["count"]), 1, 3)
    top = F.when(F.size(top) > 0, top)
    quartile = lambda q: F.when(F.col("min").isNotNull(), F.expr(f"kll_sketch_get_quantile_double(ranks, {q}D)"))
    total = F.aggregate(top, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return stats.select(
        "column", kind.alias("kind"), F.theta_sketch_estimate("ids").alias("distinct_count"),
        rnd(ratio(F.col("n") - F.col("nn"), "n"), 6).alias("nil_pct"), "earliest", "latest",
        rnd("min", 6).alias("min"), rnd(quartile(0.25), 6).alias("q1"), rnd(quartile(0.75), 6).alias("q3"),
        rnd("max", 6).alias("max"), rnd("avg", 6).alias("avg"), rnd("sd", 6).alias("sd"), rnd("skewness", 6).alias("skewness"),
        rnd("excess_kurtosis", 6).alias("excess_kurtosis"),
        F.when(kind == "number", rnd(ratio("zeros", "n"), 6)).alias("zero_fraction"),
        rnd(ratio(F.get(top, F.lit(0)), "n"), 6).alias("mode_fraction"), rnd(ratio(total, "n"), 6).alias("top3_fraction"),
    ).orderBy("column")


def profile_columns_sketch(t: Tables, p: Params) -> DataFrame:
    """M66 over the monthly package-share card, from sketches."""
    from kpiloom.operators.okr import okr_package_share

    return profile_sketched(okr_package_share(t, p.with_(grain="monthly")))


def profile_reservations_sketch(t: Tables, p: Params) -> DataFrame:
    """M66 over the reservations themselves."""
    return profile_sketched(t.reservations)


def profile_columns(t: Tables, p: Params) -> DataFrame:
    """M66 over the monthly package-share card (the result whose profile the source caches).
    Its input has one row per month, so exact quartiles are safe here."""
    from kpiloom.operators.okr import okr_package_share

    return profile_frame(okr_package_share(t, p.with_(grain="monthly")), exact_quantiles=True)


PROFILE = {"profile_columns": profile_columns, "profile_columns_sketch": profile_columns_sketch,
           "profile_reservations_sketch": profile_reservations_sketch}
