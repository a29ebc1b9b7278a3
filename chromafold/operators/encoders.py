"""Encoders of (color, feature, target) data within a column budget.

Each fit gives a small dictionary table; ``encode`` joins it (broadcast while small) and builds one row per
example: (ex_id, target, features array<struct<idx, val>>), sorted by index. Dense columns come first in the
file order of writers and have the indices from ``dense_offset`` on. Budgets count dense columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafold.functions.features import positive


@dataclass(frozen=True)
class Dictionary:
    """``table``: what a fit learnt; ``dims``: (idx, dim) of the encoded columns; ``dense_offset``: their number."""

    kind: str
    table: DataFrame
    dims: DataFrame
    dense_offset: int


def sparse_budget(budget: int, ndense: int) -> int:
    if budget <= ndense:
        raise ValueError(f"a budget of {budget} leaves no room beside {ndense} dense columns")
    return budget - ndense


def mean_sketch(features: DataFrame, lines: DataFrame) -> DataFrame:
    """(fid, cnt, mean): lines with each feature, and their mean target."""
    return features.join(lines, "ex_id").groupBy("fid").agg(F.count("*").alias("cnt"), F.avg("target").alias("mean"))


def class_sketch(features: DataFrame, lines: DataFrame) -> DataFrame:
    """(fid, pos, neg): lines with each feature by class."""
    p = positive(F.col("target"))
    return features.join(lines, "ex_id").groupBy("fid").agg(F.sum(p).alias("pos"), F.sum(1 - p).alias("neg"))


def class_totals(lines: DataFrame) -> DataFrame:
    p = positive(F.col("target"))
    return lines.agg(F.coalesce(F.sum(p), F.lit(0)).alias("pos"), F.coalesce(F.sum(1 - p), F.lit(0)).alias("neg"))


def _ones(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), F.lit(1).alias("dim"))


def fit_target(features: DataFrame, lines: DataFrame, colors: DataFrame, budget: int, ndense: int = 0) -> Dictionary:
    """Mean target per feature; the largest color classes keep a column."""
    ncolors = colors.agg(F.max("color")).first()[0]
    width = min(0 if ncolors is None else ncolors + 1, sparse_budget(budget, ndense))
    kept = mean_sketch(features, lines).join(colors.select("fid", "color"), "fid").where(F.col("color") < width)
    return Dictionary("te", kept, _ones(lines.sparkSession, width), width)


def fit_frequency(vocab: DataFrame, budget: int, ndense: int = 0) -> Dictionary:
    """One column for each of the most frequent features."""
    room = sparse_budget(budget, ndense)
    return Dictionary("ft", vocab.where(F.col("fid") < room).select("fid"), _ones(vocab.sparkSession, room), room)


def _codes(kept: DataFrame) -> DataFrame:
    """(fid, color, code): 1, 2, ... by id inside each color."""
    return kept.select("fid", "color", F.row_number().over(Window.partitionBy("color").orderBy("fid")).alias("code"))


def _code_dims(codes: DataFrame, width: int) -> DataFrame:
    sizes = codes.groupBy(F.col("color").alias("idx")).agg((F.max("code") + 1).alias("dim"))
    return _ones(codes.sparkSession, width).select("idx").join(sizes, "idx", "left").select("idx", F.coalesce("dim", F.lit(1)).alias("dim"))


def fit_field_aware(vocab: DataFrame, colors: DataFrame, budget: int, ndense: int = 0) -> Dictionary:
    """The most frequent features as ordinal codes inside their color."""
    room = sparse_budget(budget, ndense)
    codes = _codes(vocab.where(F.col("fid") < room).select("fid").join(colors.select("fid", "color"), "fid"))
    width = (codes.agg(F.max("color")).first()[0] or 0) + 1
    if width > room:
        raise ValueError(f"{width} colors do not fit {room} columns")
    return Dictionary("faft", codes, _code_dims(codes, width), width)


def fit_identity(colors: DataFrame, budget: int, ndense: int = 0) -> Dictionary:
    """Every feature as an ordinal code inside its color."""
    room = sparse_budget(budget, ndense)
    top = colors.agg(F.max("color")).first()[0]
    width = 0 if top is None else top + 1
    if width >= room:
        raise ValueError(f"{width} colors need a budget above {width}")
    codes = _codes(colors.select("fid", "color"))
    return Dictionary("id", codes, _code_dims(codes, width), width)


def entries(features: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(ex_id, idx, val) of the sparse part, without the null codes of quantized columns."""
    rows = features.join(dictionary.table, "fid")
    one = F.lit(1.0)
    if dictionary.kind == "ft":
        return rows.select("ex_id", F.col("fid").alias("idx"), one.alias("val"))
    if dictionary.kind == "te":  # the rarer feature of a color wins, then the smaller mean
        best = rows.groupBy("ex_id", F.col("color").alias("idx")).agg(F.min(F.struct("cnt", F.abs("mean").alias("size"), "mean")).alias("b"))
        return best.select("ex_id", "idx", F.col("b.mean").alias("val")).where("val <> 0")
    if dictionary.kind in ("faft", "id"):
        return rows.groupBy("ex_id", F.col("color").alias("idx")).agg(F.max("code").cast("double").alias("val"))
    return rows.groupBy("ex_id", "color").agg(F.max("quantum").alias("idx")).select("ex_id", "color", "idx", one.alias("val"))


def encode(features: DataFrame, lines: DataFrame, dictionary: Dictionary, dense: DataFrame | None = None) -> DataFrame:
    """(ex_id, target, features) of every line. ``dense``: (ex_id, d, val), d counting dense columns from 0."""
    found = entries(features, dictionary)
    quantized = dictionary.kind not in ("ft", "te", "faft", "id")
    per_line = found.groupBy("ex_id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "val")).alias("s"), *([F.collect_set("color").alias("c")] if quantized else []))
    out = lines.join(per_line, "ex_id", "left")
    none = F.array().cast("array<struct<idx:int,val:double>>")
    sparse = F.coalesce("s", none)
    if quantized:  # a color without a quantized feature takes its null's quantum, if that was kept
        nulls = dictionary.table.where("fid < 0").agg(F.collect_list(F.struct("color", "quantum")).alias("nulls"))
        out = out.join(F.broadcast(nulls))  # one row
        missing = F.filter("nulls", lambda x: ~F.array_contains(F.coalesce("c", F.array().cast("array<int>")), x["color"]))
        sparse = F.concat(sparse, F.transform(missing, lambda x: F.struct(x["quantum"].cast("int").alias("idx"), F.lit(1.0).alias("val"))))
    if dense is not None:
        columns = dense.where("val <> 0").groupBy("ex_id").agg(F.collect_list(F.struct((F.col("d") + dictionary.dense_offset).cast("int").alias("idx"), F.col("val").cast("double").alias("val"))).alias("d"))
        out = out.join(columns, "ex_id", "left")
        sparse = F.concat(sparse, F.coalesce("d", none))
    return out.select("ex_id", "target", F.sort_array(sparse).alias("features"))


def field_dims(dictionary: Dictionary, ndense: int = 0) -> DataFrame:
    """(idx, dim) of all output columns: codes count from 1, so a code column's dim is its codes plus one."""
    more = dictionary.table.sparkSession.range(ndense).select((F.col("id") + dictionary.dense_offset).cast("int").alias("idx"), F.lit(1).alias("dim"))
    return dictionary.dims.unionAll(more)


def hashing_trick(encoded: DataFrame, budget: int, bucket: Column | None = None, sign: Column | None = None, seed: int = 1234) -> DataFrame:
    """Every input column to a bucket with a sign, summed: (ex_id, target, features).

    ``bucket`` and ``sign`` are expressions over ``idx``; by default both come from seeded hashes.
    """
    idx = F.col("idx")
    bucket = bucket if bucket is not None else F.pmod(F.xxhash64(F.lit(seed), idx), F.lit(budget))
    sign = sign if sign is not None else F.pmod(F.xxhash64(F.lit(seed + 1), idx), F.lit(2)) * 2 - 1
    rows = encoded.select("ex_id", F.inline("features")).select("ex_id", bucket.cast("int").alias("idx"), (F.col("val") * sign).alias("val"))
    summed = rows.groupBy("ex_id", "idx").agg(F.sum("val").alias("val")).where("val <> 0")
    packed = summed.groupBy("ex_id").agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("features"))
    return encoded.select("ex_id", "target").join(packed, "ex_id", "left").select("ex_id", "target", F.coalesce("features", F.array().cast("array<struct<idx:int,val:double>>")).alias("features"))


def budget_report(dictionary: Dictionary, vocab: DataFrame) -> DataFrame:
    """(kind, width, nsparse, least_count): what a fit kept; least_count: the smallest vocabulary count kept."""
    kept = dictionary.table.where("fid >= 0").select("fid").join(vocab.select("fid", "cnt"), "fid").agg(F.min("cnt").alias("least_count"))
    return vocab.agg(F.count("*").alias("nsparse")).join(F.broadcast(kept)).select(F.lit(dictionary.kind).alias("kind"), F.lit(dictionary.dense_offset).alias("width"), "nsparse", "least_count")
