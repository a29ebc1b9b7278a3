"""Tables about data sets, runs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.operators.ordered import running


def grid(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All combinations of small parameter tables (each at most a few dozen rows)."""
    for other in others:
        first = first.join(F.broadcast(other))
    return first


def best_by(results: DataFrame, rows: list[str], column: str, value: str, columns: list[str], least: bool = True) -> DataFrame:
    """Pivot of the best ``value`` by ``rows`` and ``column``, with the name of the best column."""
    pick = F.min if least else F.max
    wide = results.groupBy(*rows).pivot(column, columns).agg(pick(value))
    best = (F.least if least else F.greatest)(*(F.col(f"`{c}`") for c in columns)) if len(columns) > 1 else F.col(f"`{columns[0]}`")
    named = [F.when(F.col(f"`{c}`") == best, F.lit(c)) for c in columns]
    return wide.withColumn("best", F.coalesce(*named))


def chronological_split(df: DataFrame, order: list[Column], first: int) -> DataFrame:
    """``df`` with ``part``: train for the first rows in a total order, valid for the rest."""
    ranked = running(df, order, _rank=F.lit(1))
    return ranked.withColumn("part", F.when(F.col("_rank") < first, "train").otherwise("valid")).drop("_rank")


def positional_split(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """``df`` with ``part``: train for the first ``share`` of the rows in a total order."""
    ranked = running(df, order, _rank=F.lit(1)).join(F.broadcast(df.agg((F.count("*") - 1).alias("_last"))))  # one row
    position = F.coalesce(F.try_divide("_rank", "_last"), F.lit(0.0))
    return ranked.withColumn("part", F.when(position < share, "train").otherwise("valid")).drop("_rank", "_last")


def times(preparation: DataFrame, training: DataFrame, keys: list[str]) -> DataFrame:
    """Total seconds by keys: a preparation without a record counts as 0."""
    joined = training.join(preparation.withColumnRenamed("seconds", "prepared"), keys, "left")
    return joined.select(*keys, F.coalesce("prepared", F.lit(0.0)).alias("prepare_sec"), F.col("seconds").alias("train_sec"),
                         (F.coalesce("prepared", F.lit(0.0)) + F.col("seconds")).alias("total_sec"))


def column_minima(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, low): the minimum of each column."""
    low = df.agg(*(F.min(c).cast("double").alias(c) for c in columns))
    return low.unpivot([], columns, "name", "low")


def curve(results: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Mean and extremes of ``y`` along ``x`` for each series, as a plot would take it."""
    return results.groupBy(*by, x).agg(F.avg(y).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high"), F.count(y).alias("n"))


def wide_to_long(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
