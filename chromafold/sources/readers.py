"""Readers: sparse text lines, tab-separated tables, and any DataFrame, as ``Examples``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafold.functions.features import canonical_key, feature_name, feature_value, not_blank


@dataclass(frozen=True)
class Examples:
    """Supervised sparse data in two tables.

    ``lines`` has ex_id and target, one row per example; ``tokens`` has ex_id, col, pos, key and value, one
    row per word. ``col`` is null for sparse lines and names the column of tabular data.
    """

    lines: DataFrame
    tokens: DataFrame


TOKEN = ("ex_id", "col", "pos", "key", "value")


def _split(lines: DataFrame, delimiter: str) -> DataFrame:
    """Words of each line; a delimiter at the end gives no empty last word."""
    words = F.split(F.regexp_replace("value", f"{delimiter}$", ""), delimiter)
    return lines.select("ex_id", words.alias("words"))


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ex_id, value) of every line; ids order lines within a file split and are unique."""
    return spark.read.text(paths).select(F.monotonically_increasing_id().alias("ex_id"), "value")


def svm_from_lines(lines: DataFrame, keep_values: bool = False) -> Examples:
    """``target name[:value] ...`` lines from (ex_id, value). Lines without a readable target are left out.

    ``keep_values`` makes name and value together the feature.
    """
    split = _split(lines, " ").select("ex_id", F.get("words", F.lit(0)).try_cast("double").alias("target"), "words")
    split = split.where(F.col("target").isNotNull())
    words = split.select("ex_id", F.posexplode(F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))).alias("pos", "word")).where(not_blank(F.col("word")))
    word = F.col("word")
    name = word if keep_values else feature_name(word)
    tokens = words.select("ex_id", F.lit(None).cast("string").alias("col"), "pos", canonical_key(name).alias("key"), feature_value(word).alias("value"))
    return Examples(split.select("ex_id", "target"), tokens)


def read_svm(spark: SparkSession, paths: str | list[str], keep_values: bool = False) -> Examples:
    return svm_from_lines(text_lines(spark, paths), keep_values)


def read_tsv(spark: SparkSession, paths: str | list[str]) -> Examples:
    """``target \\t c0 \\t c1 ...`` lines; columns are named by their position after the target."""
    split = _split(text_lines(spark, paths), "\t").select("ex_id", F.get("words", F.lit(0)).try_cast("double").alias("target"), "words")
    split = split.where(F.col("target").isNotNull())
    words = split.select("ex_id", F.posexplode(F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))).alias("pos", "key"))
    return Examples(split.select("ex_id", "target"), words.select("ex_id", F.col("pos").cast("string").alias("col"), "pos", "key", F.col("key").alias("value")))


def from_columns(df: DataFrame, ex_id: str, target: Column, columns: list[str]) -> Examples:
    """Every named column as a categorical column; null is the empty category."""
    values = F.array(*(F.struct(F.lit(c).alias("col"), F.lit(i).alias("pos"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")) for i, c in enumerate(columns)))
    tokens = df.select(F.col(ex_id).alias("ex_id"), F.inline(values)).select("ex_id", "col", "pos", "key", F.col("key").alias("value"))
    return Examples(df.select(F.col(ex_id).alias("ex_id"), target.cast("double").alias("target")), tokens)


def from_words(df: DataFrame, ex_id: str, word: Column, pos: Column | None = None, value: Column | None = None) -> DataFrame:
    """A tokens table from one row per word."""
    return df.select(F.col(ex_id).alias("ex_id"), F.lit(None).cast("string").alias("col"), (pos if pos is not None else F.lit(0)).alias("pos"),
                     word.cast("string").alias("key"), (value.cast("string") if value is not None else F.lit("1")).alias("value"))


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(ex_id, target, features) of a table that ``write_csr`` wrote."""
    rows = spark.read.parquet(path)
    return rows.select("ex_id", F.col("y").alias("target"), F.arrays_zip(F.col("indices").alias("idx"), F.col("data").alias("val")).alias("features"))


def read_flat(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(ex_id, target, values) of files of 32-bit little-endian floats, a target and ``columns`` values a row."""
    records = spark.sparkContext.binaryRecords(path, 4 * (columns + 1)).map(lambda r: (r,))  # the only splittable reader of fixed-width records
    rows = spark.createDataFrame(records, "r binary").select(F.monotonically_increasing_id().alias("ex_id"), "r")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column("r").to_pylist()), "<f4").reshape(-1, columns + 1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(table) + 1, dtype=np.int32) * columns), pa.array(np.ascontiguousarray(table[:, 1:]).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ex_id"), pa.array(table[:, 0].astype(float)), values], ["ex_id", "target", "values"])

    return rows.mapInArrow(decode, "ex_id long, target double, values array<float>")


def finished_runs(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of an experiment grid that have no record yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def log_seconds(lines: DataFrame, key: str) -> DataFrame:
    """(file, seconds) from log lines (file, value) that begin with ``key`` and hold a number of seconds."""
    found = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?)\s*s(?:ec(?:onds?)?)?\b", 1)
    return lines.where(F.col("value").startswith(key)).select("file", found.try_cast("double").alias("seconds")).where("seconds is not null")
