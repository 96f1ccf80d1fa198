"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is one aggregation by vertex and one join with the links; no vertex's
neighbours are ever gathered in one place. The number of rounds grows with the
logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessio.llm.base import forget, settled


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest vertex around."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links run from the larger to the smaller vertex; a vertex's smaller ones are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u")
    return hung.select("v", F.col("m").alias("w")).where("v != w").unionByName(least.select(F.col("u").alias("v"), F.col("m").alias("w"))).distinct().select(F.col("v").alias("u"), F.col("w").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """vertex, root (the smallest vertex it reaches), for all vertices of links but the roots.

    links: u and v of one ordered type. Loops and repeated links are harmless.
    """
    stars = settled(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        last, stars = stars, settled(_small_star(_large_star(stars)))
        forget(last)
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return stars.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        before = now
