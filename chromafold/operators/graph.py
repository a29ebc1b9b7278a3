"""The co-occurrence graph of sparse features: edges, degrees, thresholds and masks.

Edges are (l, r, freq) with l < r. A line's pairs are made inside its row from the sorted feature array, so the
only shuffle is the count by pair, combined before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_counts(arrays: DataFrame) -> DataFrame:
    """(l, r, freq): on how many lines two features occur together."""
    pairs = F.flatten(F.transform("fids", lambda x, i: F.transform(F.slice("fids", i + 2, F.size("fids")), lambda y: F.struct(x.alias("l"), y.alias("r")))))
    return arrays.where(F.size("fids") > 1).select(F.inline(pairs)).groupBy("l", "r").agg(F.count("*").alias("freq"))


def threshold(edges: DataFrame, k: int) -> DataFrame:
    """Edges of at least ``k`` lines."""
    return edges.where(F.col("freq") >= k)


def both_ways(edges: DataFrame) -> DataFrame:
    """(fid, other, freq), each edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("l").alias("fid"), F.col("r").alias("other"), "freq"), F.struct(F.col("r").alias("fid"), F.col("l").alias("other"), "freq"))).alias("e")).select("e.*")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, degree) of every vertex, isolated ones included."""
    found = both_ways(edges).groupBy("fid").agg(F.count("*").alias("degree"))
    return vertices.select("fid").join(found, "fid", "left").select("fid", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(max_degree, avg_degree, floor_avg_degree) over all vertices."""
    d = degrees(edges, vertices)
    return d.agg(F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"), F.floor(F.sum("degree") / F.count("*")).alias("floor_avg_degree"))


def without(edges: DataFrame, masked: DataFrame) -> DataFrame:
    """Edges with neither end among the masked vertices."""
    gone = masked.select("fid")
    return edges.join(gone, edges.l == gone.fid, "left_anti").join(gone, edges.r == gone.fid, "left_anti")


def masked_degrees(edges: DataFrame, vertices: DataFrame, masked: DataFrame) -> DataFrame:
    """Degrees of the unmasked vertices in the whole graph: masked neighbours count."""
    return degrees(edges, vertices).join(masked.select("fid"), "fid", "left_anti")


def frequency_counts(edges: DataFrame) -> DataFrame:
    """(freq, edges): how many edges have each frequency."""
    return edges.groupBy("freq").agg(F.count("*").alias("edges"))


def edge_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges that only one of two edge tables holds, with multiplicity."""
    columns = ["l", "r", "freq"]
    return a.select(columns).exceptAll(b.select(columns)).unionAll(b.select(columns).exceptAll(a.select(columns)))
