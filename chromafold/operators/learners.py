"""Learners on encoded data, their metrics, and synthetic data."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import PolynomialExpansion, VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafold.functions.features import positive
from chromafold.operators.ordered import running


def vectors(encoded: DataFrame, width: int) -> DataFrame:
    """(ex_id, label, features): encoded rows as vectors of a given width; entries beyond it are left out.

    The width is that of the training data, so a test matrix is padded to it.
    """
    values = F.map_from_entries(F.filter("features", lambda e: e["idx"] < width))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(values, i.cast("int")), F.lit(0.0)))
    return encoded.select("ex_id", positive(F.col("target")).cast("double").alias("label"), array_to_vector(dense).alias("features"))


def learner(name: str, quadratic: bool = False, categories: int = 0, iterations: int = 20) -> Pipeline:
    """``lr`` (online linear learners' model), ``gbt`` (boosted trees; ``categories`` > 0 indexes columns) or ``fm``."""
    stages = [PolynomialExpansion(degree=2, inputCol="features", outputCol="expanded")] if quadratic else []
    column = "expanded" if quadratic else "features"
    if categories:
        stages.append(VectorIndexer(inputCol=column, outputCol="indexed", maxCategories=categories, handleInvalid="keep"))
        column = "indexed"
    kinds = {
        "lr": lambda: LogisticRegression(featuresCol=column, maxIter=iterations, regParam=1e-4),
        "gbt": lambda: GBTClassifier(featuresCol=column, maxIter=iterations, seed=7, maxBins=max(32, categories)),
        "fm": lambda: FMClassifier(featuresCol=column, maxIter=5 * iterations, factorSize=4, stepSize=0.05, regParam=1e-4, seed=7),
    }
    return Pipeline(stages=[*stages, kinds[name]()])


def predictions(model: PipelineModel, data: DataFrame) -> DataFrame:
    """(ex_id, label, p): the probability of the positive class."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(data).select("ex_id", "label", vector_to_array("probability")[1].alias("p"))


def metrics(scored: DataFrame) -> DataFrame:
    """(n, accuracy, logloss, auc) of (label, p) rows; auc by average ranks of tied scores.

    Scores are counted before they are ranked, so the running total goes over distinct scores.
    """
    eps = 1e-15
    p = F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps))
    loss = F.when(F.col("label") > 0, -F.log(p)).otherwise(-F.log(1 - p))
    plain = scored.agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("label") > 0)).cast("double")).alias("accuracy"), F.avg(loss).alias("logloss"))
    y = positive(F.col("label"))
    counts = scored.groupBy("p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    pairs = running(counts, [F.col("p")], less=F.col("neg"))
    area = pairs.agg(F.try_divide(F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return plain.join(F.broadcast(area))  # one row each


def synthetic(spark: SparkSession, rows: int, features: int, expected: float, ratio: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Lines (ex_id, target) and features (ex_id, fid) of independent features with geometric probabilities.

    Probabilities fall from the first feature to the last by ``ratio`` in all and sum to ``expected``.
    """
    p = probabilities(spark, features, expected, ratio)
    lines = spark.range(rows).select(F.col("id").alias("ex_id"), (F.rand(seed) < 0.5).cast("double").alias("target"))
    sure = p.select("fid", F.col("p"))
    # how many lines a feature is on, then which: work follows the output, not rows x features
    def unit(*salt) -> object:
        return F.pmod(F.xxhash64(F.lit(seed), "fid", *salt), F.lit(1 << 30)) / (1 << 30)

    noise = F.sqrt(-2 * F.log(1 - unit(F.lit(1)))) * F.cos(6.283185307179586 * unit(F.lit(2)))
    count = F.greatest(F.lit(0), F.round(rows * F.col("p") + noise * F.sqrt(rows * F.col("p") * (1 - F.col("p"))))).cast("int")
    drawn = sure.select("fid", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))).alias("i"))
    hits = drawn.select(F.floor(unit("i") * rows).cast("long").alias("ex_id"), "fid").distinct()
    return lines, hits


def probabilities(spark: SparkSession, features: int, expected: float, ratio: float) -> DataFrame:
    """(fid, p): geometric, with largest over smallest ``ratio`` and sum ``expected`` (each at most 1)."""
    step = ratio ** (-1 / max(1, features - 1))
    total = features if step == 1 else (1 - step**features) / (1 - step)
    return spark.range(features).select(F.col("id").cast("int").alias("fid"), F.least(F.lit(1.0), F.lit(expected / total) * F.pow(F.lit(step), F.col("id"))).alias("p"))
