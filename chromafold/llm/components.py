"""Connected components of a graph held as a DataFrame of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the vertex; both split a vertex that holds many links, and
nothing is collected but one row of sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromafold.llm.lineage import hold


def _lowest(pairs: DataFrame) -> DataFrame:
    """Every (u, v) of ``pairs`` with m, the smallest of u and its partners."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    low = low.repartition(low.sparkSession.sparkContext.defaultParallelism)  # keeps the join's shuffle splittable
    return pairs.join(low, pairs.u == low.w).select("u", "v", "m")


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex with a link; root is the smallest vertex of its component.

    ``links`` has two columns of one orderable type; repeats, loops, nulls and either direction are allowed.
    """
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = hold(edges.where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        large = _lowest(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = _lowest(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        edges = hold(small.where("u > v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
