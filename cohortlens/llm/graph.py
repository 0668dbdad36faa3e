"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v); the root is the smallest node of its component.

    Every step is a minimum by node (combined before the shuffle) and a join on
    the node, so a hub costs its own rows and can be split by adaptive skew
    joins.  The table is written to the shared folder after each round; nothing
    but a row count and a checksum comes to the driver.
    """

    def halves(a, b):
        return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = cut(edges.where("u <> v").select(*halves(F.col("u"), F.col("v"))).distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(*halves(F.col("v"), F.col("m"))).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
