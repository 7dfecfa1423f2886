"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.shared import materialize


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v) -> (node, root): every node of an edge with the smallest node it can reach.

    Each round points the neighbours of a node at the smallest of them: the larger ones first (large
    star), then the others (small star), until every edge is a node and its root. Rounds grow with
    the logarithm of a component's size. Minima are partial aggregates, and the join back to the
    edges is one that adaptive execution splits at hot nodes; no node's neighbours are gathered. Each
    round is a table in ``folder``, so a lost executor never reaches back beyond one round."""
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, step, seen = materialize(pairs, f"{folder}/edges-0"), 0, None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now goes from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        ).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        step += 1
        pairs = materialize(small, f"{folder}/edges-{step}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
