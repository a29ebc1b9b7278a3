"""Vocabulary: word counts, the dense/sparse split, feature ids, dense columns and line statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafold.functions.features import number
from chromafold.operators.ordered import running
from chromafold.sources.lineage import hold
from chromafold.sources.readers import Examples

WINDOW_ROWS = 200_000  # tables of at most so many rows are numbered in one partition
#: The points of the quantile report, in thousandths of a percent.
QUANTILES = (0, 25_000, 50_000, 75_000, 90_000, 95_000, 99_000, 99_900, 99_990, 99_999, 100_000)


def ordinal(df: DataFrame, order: list[Column], name: str, spread: bool | None = None) -> DataFrame:
    """``df`` with a 0-based number in the given total order, the same either way.

    A table of at most WINDOW_ROWS rows (counted unless ``spread`` says so) is sorted in one partition, a larger
    one by range over all partitions.
    """
    if spread is None:
        df = hold(df)
        spread = df.count() > WINDOW_ROWS
    if not spread:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    return running(df, order, **{name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def cardinality(data: Examples) -> DataFrame:
    """(nlines, nwords, nfeatures)."""
    words = data.tokens.agg(F.count("*").alias("nwords"), F.countDistinct("col", "key").alias("with_col"), F.countDistinct("key").alias("alone"), F.count("col").alias("cols"))
    words = words.select("nwords", F.when(F.col("cols") > 0, F.col("with_col")).otherwise(F.col("alone")).alias("nfeatures"))
    return data.lines.agg(F.count("*").alias("nlines")).join(F.broadcast(words))  # one row each


def word_counts(tokens: DataFrame) -> DataFrame:
    """(col, key, cnt): occurrences, repeats on a line included."""
    return tokens.groupBy("col", "key").agg(F.count("*").alias("cnt"))


def fit_vocab(data: Examples, dense_fraction: float = 0.1, freq_cutoff: int = 0, spread: bool | None = None) -> DataFrame:
    """(key, cnt, dense, fid) of sparse text: ids by falling count, then key; sparse features first.

    A feature is dense from ``floor(lines * dense_fraction)`` occurrences on; a fraction above 1 turns that off.
    """
    counts = word_counts(data.tokens).select("key", "cnt").where(F.col("cnt") >= freq_cutoff)
    lines = F.broadcast(data.lines.agg(F.count("*").alias("_n")))  # one row
    dense = F.lit(False) if dense_fraction > 1 else F.col("cnt") >= F.floor(F.col("_n") * dense_fraction)
    split = counts.join(lines).select("key", "cnt", dense.alias("dense"))
    return ordinal(split, [F.col("dense"), F.col("cnt").desc(), F.col("key")], "fid", spread)


def fit_table_vocab(data: Examples, spread: bool | None = None) -> DataFrame:
    """(col, key, cnt, fid) of categorical columns: ids over all columns by falling count, column, key."""
    return ordinal(word_counts(data.tokens), [F.col("cnt").desc(), F.col("col").desc(), F.col("key").desc()], "fid", spread)


def line_features(data: Examples, vocab: DataFrame) -> DataFrame:
    """(ex_id, fid): the distinct sparse features of each line; unknown words are left out."""
    sparse = vocab.where("not dense") if "dense" in vocab.columns else vocab
    on = ["col", "key"] if "col" in vocab.columns else ["key"]
    return data.tokens.join(sparse.select(*on, "fid"), on).select("ex_id", "fid").distinct()


def line_arrays(data: Examples, vocab: DataFrame) -> DataFrame:
    """(ex_id, target, fids): each line's distinct sparse features, sorted; lines without any have an empty array."""
    found = line_features(data, vocab).groupBy("ex_id").agg(F.sort_array(F.collect_list("fid")).alias("fids"))
    return data.lines.join(found, "ex_id", "left").select("ex_id", "target", F.coalesce("fids", F.array().cast("array<int>")).alias("fids"))


def dense_values(data: Examples, vocab: DataFrame, permissive: bool = True) -> DataFrame:
    """(ex_id, fid, val): the last value of each dense feature on a line."""
    rows = data.tokens.join(vocab.where("dense").select("key", "fid"), "key")
    last = rows.groupBy("ex_id", "fid").agg(F.max_by("value", "pos").alias("value"))
    return last.select("ex_id", "fid", number(F.col("value"), permissive).alias("val"))


def line_stats(arrays: DataFrame) -> DataFrame:
    """(nlines, max_nnz, avg_nnz, avg_pairs): averages by whole-number division over all lines."""
    n = F.size("fids").cast("long")
    return arrays.agg(F.count("*").alias("nlines"), F.max(n).alias("max_nnz"), F.floor(F.sum(n) / F.count("*")).alias("avg_nnz"),
                      F.floor(F.sum(n * (n - 1) / 2) / F.count("*")).alias("avg_pairs"))


def word_stats(data: Examples) -> DataFrame:
    """(min, median, mean, max) words per line."""
    per_line = data.lines.select("ex_id").join(data.tokens.groupBy("ex_id").agg(F.count("*").alias("n")), "ex_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per_line.agg(F.min("n").alias("min_nnz"), F.percentile("n", F.lit(0.5)).alias("median_nnz"), F.avg("n").alias("mean_nnz"), F.max("n").alias("max_nnz"))


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """(point, value): nearest-rank values at QUANTILES, no interpolation.

    Equal values are counted first, so the running total goes over the distinct values only.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = running(counts, [F.col("value")], hi=F.col("n")).withColumn("hi", F.col("hi") + F.col("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    points = F.array(*map(F.lit, QUANTILES))
    rank = F.floor(F.col("point") * (F.col("total") - 1) / 100_000)
    return upto.join(total).withColumn("point", F.explode(points)).where((rank >= F.col("hi") - F.col("n")) & (rank < F.col("hi"))).select("point", "value")
