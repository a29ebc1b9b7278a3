"""Graph diagnostics: unseen-edge estimates, actual new edges, degree under thresholds, color collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromafold.operators import graph


def thresholds(spark: SparkSession, max_k: int) -> DataFrame:
    return spark.range(1, max_k + 1).select(F.col("id").cast("int").alias("k"))


def good_turing(edges: DataFrame, n_train: int, max_k: int) -> DataFrame:
    """(k, good_turing): the edges seen at most k times, weighted by frequency, per training line."""
    by_freq = graph.frequency_counts(edges).where(F.col("freq") <= max_k).select(F.col("freq").alias("k"), (F.col("freq") * F.col("edges")).alias("mass"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # at most max_k rows
    rows = thresholds(edges.sparkSession, max_k).join(by_freq, "k", "left")
    return rows.select("k", (F.sum(F.coalesce("mass", F.lit(0))).over(upto) / n_train).alias("good_turing"))


def new_edges(train: DataFrame, valid: DataFrame, n_valid: int, max_k: int) -> DataFrame:
    """(k, new_edges): valid edges that training saw fewer than k times, per validation line."""
    seen = train.select("l", "r", F.col("freq").alias("train_freq"))
    by_freq = valid.join(seen, ["l", "r"], "left").select(F.coalesce("train_freq", F.lit(0)).alias("f"), "freq")
    by_freq = by_freq.where(F.col("f") < max_k).groupBy("f").agg(F.sum("freq").alias("mass"))
    rows = F.broadcast(thresholds(train.sparkSession, max_k))
    return rows.join(by_freq, F.col("f") < F.col("k"), "left").groupBy("k").agg((F.coalesce(F.sum("mass"), F.lit(0)) / n_valid).alias("new_edges"))


def threshold_degrees(edges: DataFrame, vertices: DataFrame, max_k: int) -> DataFrame:
    """(k, max_degree, avg_degree) of the graphs of edges seen at least k times, over all vertices."""
    ks = [F.count_if(F.col("freq") >= k).alias(f"d{k}") for k in range(1, max_k + 1)]
    per_vertex = graph.both_ways(edges).groupBy("fid").agg(*ks)
    n = F.broadcast(vertices.agg(F.count("*").alias("n")))
    wide = per_vertex.agg(*(f(f"d{k}").alias(f"{name}{k}") for k in range(1, max_k + 1) for name, f in (("m", F.max), ("s", F.sum)))).join(n)
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"m{k}", F.lit(0)).alias("max_degree"), (F.coalesce(f"s{k}", F.lit(0)) / F.col("n")).alias("avg_degree")) for k in range(1, max_k + 1)))
    return wide.select(F.inline(rows))


def collisions(line_features: DataFrame, lines: DataFrame, colors: DataFrame) -> DataFrame:
    """(mean, std): per line, known features less their distinct colors; all lines count."""
    per_line = line_features.join(colors, "fid").groupBy("ex_id").agg((F.countDistinct("fid") - F.countDistinct("color")).alias("x"))
    x = F.coalesce("x", F.lit(0)).cast("double")
    return lines.select("ex_id").join(per_line, "ex_id", "left").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def color_violations(line_features: DataFrame, colors: DataFrame) -> DataFrame:
    """(ex_id, color): two features of one color on one line; none for a valid coloring's training lines."""
    return line_features.join(colors, "fid").groupBy("ex_id", "color").agg(F.countDistinct("fid").alias("n")).where("n > 1").select("ex_id", "color")


def class_sizes(colors: DataFrame) -> DataFrame:
    return colors.groupBy("color").agg(F.count("*").alias("n"))


def color_bound(stats: DataFrame, k: float = 1.0) -> DataFrame:
    """An upper bound on colors: 2 max_degree + good_turing + k max_nnz^2 / sqrt(n_train) ln 100, plus masked vertices."""
    bound = 2 * F.col("max_degree") + F.col("good_turing") + k * F.col("max_nnz") * F.col("max_nnz") / F.sqrt("n_train") * F.log(F.lit(100.0)) + F.coalesce(F.col("masked"), F.lit(0))
    return stats.withColumn("color_bound", bound)


def random_bucket_collisions(probabilities: DataFrame, bucket) -> DataFrame:
    """(expected): the sum over buckets of sum(p) - 1 + product(1 - p), for independent features with column p."""
    per = probabilities.groupBy(bucket.alias("bucket")).agg((F.sum("p") - 1 + F.product(1 - F.col("p"))).alias("x"))
    return per.agg(F.sum("x").alias("expected"))
