"""Facts in folders of months, and reports bounded by a table instead of literals.

Where the bounds of a report are data (a row that another job writes), a plan cannot prune files by them when it is
made. With facts partitioned by month and the bounds' months joined to them, Spark prunes the folders when it runs: the
bounds are read first, and only their months are listed (dynamic partition pruning).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.okr import okr_orders, okr_sales
from kpiloom.params import Params
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables


def write_monthly(t: Tables, root: str, names: tuple[str, ...] = ("reservations",), column: str = "created_at") -> Tables:
    """Write tables partitioned by ``month`` ('YYYY-MM' of ``column``) under ``root``; ``t`` with them in place of its own."""
    spark = t[names[0]].sparkSession
    out = {}
    for name in names:
        rows = t[name].withColumn("month", F.date_format(column, "yyyy-MM"))
        rows.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{root.rstrip('/')}/{name}")
        out[name] = spark.read.schema(rows.schema).parquet(f"{root.rstrip('/')}/{name}")
    return t.replace(**out)


def within_bounds(facts: DataFrame, bounds: DataFrame, column: str = "created_at") -> DataFrame:
    """Rows of monthly ``facts`` whose ``column`` lies in [lo, hi) of the one row of ``bounds`` (lo, hi: dates). No row in
    ``bounds``, or a NULL bound, gives no rows; more than one would repeat facts and is an error."""
    one = bounds.agg(F.count(F.lit(1)).alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        F.when(F.col("rows") > 1, F.raise_error(F.lit("bounds hold more than one row"))).otherwise(F.col("lo")).cast("date").alias("lo"),
        F.col("hi").cast("date").alias("hi"))
    months = F.sequence(F.trunc("lo", "MM"), F.date_sub("hi", 1), F.expr("INTERVAL 1 MONTH"))
    span = one.where("lo < hi").select("lo", "hi", F.explode(months).alias("first")).select(
        "lo", "hi", F.date_format("first", "yyyy-MM").alias("month"))
    # a row for each month of the range
    joined = facts.join(F.broadcast(span), "month").where((F.col(column) >= F.col("lo")) & (F.col(column) < F.col("hi")))
    return joined.select(*facts.columns)


def _bounded(t: Tables, p: Params) -> Tables:
    """Monthly reservations within the bounds of ``p``, which are written as a table first."""
    spark = t.reservations.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiloom-monthly-{uuid.uuid4().hex}"
    spark.createDataFrame([(p.date_from, p.date_to)], "lo date, hi date").write.parquet(f"{root}/bounds")
    monthly = write_monthly(t, root)
    bounds = spark.read.schema("lo date, hi date").parquet(f"{root}/bounds")
    return monthly.replace(reservations=within_bounds(monthly.reservations, bounds))


def orders_within_bounds(t: Tables, p: Params) -> DataFrame:
    """M12 by day, between the bounds of a table."""
    return okr_orders(_bounded(t, p), p.with_(grain="daily", date_from=None, date_to=None))


def sales_within_bounds(t: Tables, p: Params) -> DataFrame:
    """M11 by month, between the bounds of a table."""
    return okr_sales(_bounded(t, p), p.with_(grain="monthly", date_from=None, date_to=None))
