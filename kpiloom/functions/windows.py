"""Window idioms of the reports.

Windows without PARTITION BY run in one task; they are only ever applied to
per-period aggregates (one row per day/week/month of the report range), whose
size is bounded by the number of periods, never by the fact table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import c, minutes_between, ratio, rnd

__all__ = [
    "merge_on_key", "neighbor_in_time", "running", "running_ratio", "pop_pct", "pop_points", "share_of_total", "next_gap_minutes",
    "prev_gap_minutes", "first_seen", "min_day_text",
]


def merge_on_key(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge of frames that each hold at most one row per ``key``.

    Written as UNION ALL + GROUP BY key (max of each column) instead of a spine and a
    chain of outer joins: every input is evaluated once and the merge is one partial
    aggregate + one shuffle of per-key rows, however many frames there are."""
    cols: list[str] = []
    for f in frames:
        cols += [x for x in f.columns if x != key and x not in cols]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.groupBy(key).agg(*[F.max(x).alias(x) for x in cols])


def _running_w(order: str) -> Window:
    # the SQL default frame with ORDER BY: RANGE UNBOUNDED PRECEDING .. CURRENT ROW
    return Window.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def running(x: str | Column, order: str = "period") -> Column:
    """SUM(x) OVER (ORDER BY order) over a per-period aggregate."""
    return F.sum(c(x)).over(_running_w(order))


def running_ratio(a: str | Column, b: str | Column, order: str = "period", scale: float = 1.0) -> Column:
    num = running(a, order)
    if scale != 1.0:
        num = num * F.lit(scale)
    return ratio(num, running(b, order))


def pop_pct(x: str, order: str = "period") -> Column:
    """Period-over-period change in percent against the previous *present* period."""
    w = Window.orderBy(order)
    prev = F.lag(c(x)).over(w)
    return rnd(ratio((c(x) - prev) * 100, prev), 1)


def pop_points(x: str, order: str = "period") -> Column:
    """Period-over-period change in points (for percentages and averages)."""
    w = Window.orderBy(order)
    return rnd(c(x) - F.lag(c(x)).over(w), 1)


def share_of_total(x: str | Column, scale: float = 1.0) -> Column:
    """scale * x / SUM(x) OVER () over an already aggregated frame (one row per group)."""
    num = c(x) * F.lit(scale) if scale != 1.0 else c(x)
    return ratio(num, F.sum(c(x)).over(Window.partitionBy()))


def neighbor_in_time(df: DataFrame, keys: list[str], ts: str, value: str, out: str, direction: int = 1,
                     bucket_seconds: int = 3600) -> DataFrame:
    """``LEAD(value)`` (direction=1) or ``LAG(value)`` (direction=-1) over
    ``PARTITION BY keys ORDER BY ts``, exact and skew-safe.

    A plain window sends each key group to one task, so a key holding a third of all
    rows becomes one straggler. Here the window runs per (keys, time bucket of ts):
    group size is bounded by rows per bucket, not per key. Rows at a bucket edge get
    their neighbour from the adjacent non-empty bucket: the same window marks the row
    each bucket hands to its neighbour (its first row for LEAD, its last for LAG), and a
    LEAD/LAG over those rows, one per bucket, passes it across. The hand-over rows come
    from the window's own output, so when ``df`` holds only keys, ts and value (plus the
    bucket), both branches share one exchange and the input is scanned and shuffled
    once. Ties in ``ts`` are ordered by ``value`` (any order of ties is a valid LEAD/LAG),
    so a stage recomputed after a lost executor gives the same values."""
    b = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).alias("_bucket")
    fn, back = (F.lead, F.lag) if direction > 0 else (F.lag, F.lead)
    # ``value`` breaks ties in ``ts``: rows tied on both carry the same values, so every aggregate
    # of the result is the same on a rerun, whatever order a shuffle delivers tied rows in
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts, value)
    x = df.withColumn("_bucket", b).select(
        "*", fn(F.col(value)).over(w).alias(out), fn(F.lit(1)).over(w).isNull().alias("_edge_row"),
        back(F.lit(1)).over(w).isNull().alias("_hand_over"))
    edges = x.where(F.col("_hand_over")).select(
        *keys, "_bucket", fn(F.col(value)).over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_nv"))
    j = x.join(edges, keys + ["_bucket"], "left")
    return j.withColumn(out, F.when(F.col("_edge_row"), F.col("_nv")).otherwise(F.col(out))).drop(
        "_bucket", "_edge_row", "_hand_over", "_nv")


def next_gap_minutes(df: DataFrame, keys: list[str], start: str, end: str, out: str = "gap") -> DataFrame:
    """Minutes from each job's end to the *next* job's start within ``keys`` (ordered by start):
    TIMESTAMPDIFF(MINUTE, end, LEAD(start) OVER (PARTITION BY keys ORDER BY start))."""
    x = neighbor_in_time(df, keys, start, start, "_next", direction=1)
    return x.withColumn(out, minutes_between(c(end), F.col("_next"))).drop("_next")


def prev_gap_minutes(df: DataFrame, keys: list[str], start: str, end: str, out: str = "gap") -> DataFrame:
    """Minutes from the *previous* job's end to this job's start (LAG(end) within keys)."""
    x = neighbor_in_time(df, keys, start, end, "_prev", direction=-1)
    return x.withColumn(out, minutes_between(F.col("_prev"), c(start))).drop("_prev")


def first_seen(df: DataFrame, key: str, ts: str, out: str = "first_at") -> DataFrame:
    """MIN(ts) per key: a partial (map-side) aggregate, so a hot key costs one row per task."""
    return df.groupBy(key).agg(F.min(ts).alias(out))


def min_day_text(rows: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """MIN(text) per key over 'YYYY-MM-DD' day text, exact, as hash aggregates.

    Spark has no fixed-width buffer for MIN over a string, so it plans a sort-based
    aggregate: every input row is sorted before the map-side partial aggregate. A
    canonical day string (one that round-trips through a DATE) orders exactly like that
    date, so those rows are reduced as DATE in a hash aggregate. Any other text keeps the
    lexical rule: it stays in the grouping key of that aggregate, and a second step takes
    the lexical MIN over its output, which holds about one row per key, not per input row."""
    s = F.col(text)
    d = F.try_to_date(s, "yyyy-MM-dd")
    canon = F.coalesce(F.date_format(d, "yyyy-MM-dd") == s, F.lit(False))
    step = (rows.select(key, F.when(canon, d).alias("_d"), F.when(~canon, s).alias("_other"))
            .groupBy(key, "_other").agg(F.min("_d").alias("_d")))
    return step.groupBy(key).agg(
        F.min(F.coalesce(F.col("_other"), F.date_format("_d", "yyyy-MM-dd"))).alias(out))
