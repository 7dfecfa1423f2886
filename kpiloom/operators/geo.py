"""Geographic distribution (M50): orders per area of one city, with share of the city.

Rows are aggregated per ``area_id`` before the area names are attached, so the
join sees one row per area whatever the fact size; the share-of-total window
runs over that per-area result only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import apply_date_filter, bsum, dec, in_range, live, ratio, rnd
from kpiloom.functions.windows import share_of_total
from kpiloom.params import Params
from kpiloom.sources.tables import Tables


def orders_by_area(t: Tables, p: Params) -> DataFrame:
    """Date-range variant (``date_from``/``date_to``) or month variant (``month``)."""
    r = live(t.reservations).where(F.col("city_id") == p.city_id)
    r = apply_date_filter(r, "created_at", p)
    mb = p.month_bounds()
    if mb is not None:  # DATE_FORMAT(created_at,'%Y-%m') = month, written as a sargable range
        r = r.where(in_range("created_at", *mb))
    price = dec("total_price")
    per_area = r.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("n"), bsum(F.col("use_package") == 0).alias("sgl"),
        bsum(F.col("use_package") == 1).alias("pkg"), F.sum(price).alias("s"), F.count(price).alias("c"))
    areas = t.areas.select(F.col("id").alias("aid"), F.col("name").alias("area"))
    j = per_area.join(areas, per_area["area_id"] == areas["aid"], "inner")
    g = j.groupBy("area").agg(F.sum("n").alias("orders"), F.sum("sgl").alias("single"), F.sum("pkg").alias("package"),
                              F.sum("s").alias("s"), F.sum("c").alias("c"))
    return (g.select("area", "orders", "single", "package", rnd(ratio("s", "c"), 0).alias("avg_price"),
                     rnd(share_of_total("orders", 100), 1).alias("share_pct"))
            .orderBy(F.desc("orders"), F.asc("area")))


GEO = {"orders_by_area": orders_by_area}
