"""The Spark SQL surface: the source tables as temp views, the anchored-week bucket as a
SQL function, and report text with named parameter markers (``spark.sql(q, args=...)``)
in place of the BI tool's {{variable}} / [[optional clause]] templates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from kpiloom.params import Params
from kpiloom.sources.tables import Tables

WEEK_FUNCTION = ("CREATE OR REPLACE TEMPORARY FUNCTION kpi_week(d DATE, anchor DATE) RETURNS DATE "
                 "RETURN date_add(anchor, CAST(floor(datediff(d, anchor) / 7) * 7 AS INT))")


def register_views(spark: SparkSession, t: Tables, names: list[str] | None = None) -> None:
    for n in names or t.names():
        t[n].createOrReplaceTempView(n)
    spark.sql(WEEK_FUNCTION)


def _period_sql(grain: str) -> str:
    if grain == "monthly":
        return "trunc(created_at, 'MM')"
    if grain == "weekly":
        return "kpi_week(to_date(created_at), :anchor)"
    return "to_date(created_at)"


def growth_orders_sql(p: Params) -> tuple[str, dict]:
    """M02 as parameterised SQL: the optional date bounds are markers; an unset bound is NULL
    and its predicate is TRUE (the [[ ... ]] optional clause)."""
    cum = p.effective_grain == "cumulative"
    value = "SUM(n) OVER (ORDER BY period)" if cum else "n"
    text = f"""
WITH g AS (
  SELECT {_period_sql(p.effective_grain)} AS period, COUNT(*) AS n
  FROM reservations
  WHERE deleted_at IS NULL
    AND (:date_from IS NULL OR created_at >= :date_from)
    AND (:date_to IS NULL OR created_at < :date_to)
  GROUP BY 1)
SELECT period, CAST({value} AS BIGINT) AS orders FROM g ORDER BY period"""
    ts = lambda d: dt.datetime(d.year, d.month, d.day) if d else None
    args = {"date_from": ts(p.date_from), "date_to": ts(p.date_to), "anchor": p.anchor}
    return text, args


def growth_orders_via_sql(t: Tables, p: Params) -> DataFrame:
    spark = t.reservations.sparkSession
    register_views(spark, t, ["reservations"])
    text, args = growth_orders_sql(p)
    return spark.sql(text, args=args)
