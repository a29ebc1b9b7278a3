"""Writers: encoded lines, field dimensions, graph dumps, CSR arrays and run records."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.operators.ordered import running


def output_path(path: str, suffix: str) -> str:
    """``path`` with its last extension replaced."""
    return f"{os.path.splitext(path)[0]}.{suffix}"


def suffix(kind: str, budget: int) -> str:
    """The extension of encoded files: kind and budget, as ``ft1024.svm``."""
    return f"{kind}{budget}.svm"


def number_text(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def svm_line(target: Column, entries: Column) -> Column:
    """``target idx:val ...`` from array<struct<idx, val>>."""
    pairs = F.transform(entries, lambda e: F.concat_ws(":", e["idx"].cast("string"), number_text(e["val"])))
    return F.concat_ws(" ", number_text(target), F.array_join(pairs, " "))


def write_svm(encoded: DataFrame, path: str, single_file: bool = False) -> None:
    """Encoded rows (ex_id, target, features) as text; ``single_file`` keeps the order of ids in one file."""
    lines = encoded.select("ex_id", F.rtrim(svm_line(F.col("target"), F.col("features"))).alias("value"))
    if single_file:
        lines = lines.coalesce(1).sortWithinPartitions("ex_id")
    lines.select("value").write.mode("overwrite").text(path)


def write_field_dims(dims: DataFrame, path: str) -> None:
    """One integer per output column, in column order."""
    dims.coalesce(1).sortWithinPartitions("idx").select(F.col("dim").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, degrees: DataFrame, path: str) -> None:
    """``left right`` lines at ``path``, and one degree per vertex beside it."""
    edges.select(F.concat_ws(" ", "l", "r").alias("value")).write.mode("overwrite").text(path)
    degrees.coalesce(1).sortWithinPartitions("fid").select(F.col("degree").cast("string").alias("value")).write.mode("overwrite").text(f"{os.path.splitext(path)[0]}.degree.txt")


def csr_rows(encoded: DataFrame) -> DataFrame:
    """(ex_id, y, indptr, indices, data): CSR with indptr the number of entries up to and including the row."""
    n = F.size("features")
    placed = running(encoded, [F.col("ex_id")], indptr=n)
    return placed.select("ex_id", F.col("target").alias("y"), (F.col("indptr") + n).alias("indptr"),
                         F.transform("features", lambda e: e["idx"]).alias("indices"), F.transform("features", lambda e: e["val"]).alias("data"))


def write_csr(encoded: DataFrame, path: str) -> None:
    """CSR rows as a columnar table in the order of ids."""
    csr_rows(encoded).repartitionByRange("ex_id").sortWithinPartitions("ex_id").write.mode("overwrite").parquet(path)


def concat_csr(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(block, ex_id, y, indptr, indices, data): the rows of ``upper`` (block 0) and then those of ``lower``."""
    before = F.broadcast(upper.agg(F.coalesce(F.max("indptr"), F.lit(0)).alias("_before")))  # one row
    moved = lower.join(before).select(F.lit(1).alias("block"), "ex_id", "y", (F.col("indptr") + F.col("_before")).alias("indptr"), "indices", "data")
    return upper.select(F.lit(0).alias("block"), "ex_id", "y", "indptr", "indices", "data").unionAll(moved)


def stack_columns(left: DataFrame, right: DataFrame, offset: int) -> DataFrame:
    """Rows of two encoded tables side by side: the right one's indices move up by ``offset``. Targets must agree."""
    moved = right.select("ex_id", F.col("target").alias("_target"), F.transform("features", lambda e: F.struct((e["idx"] + offset).alias("idx"), e["val"].alias("val"))).alias("_more"))
    same = F.when(F.col("target") != F.col("_target"), F.raise_error(F.lit("targets differ"))).otherwise(F.col("target"))
    return left.join(moved, "ex_id").select("ex_id", same.alias("target"), F.concat("features", "_more").alias("features"))


def append_record(record: DataFrame, path: str) -> None:
    """Run records as JSON lines."""
    record.write.mode("append").json(path)
