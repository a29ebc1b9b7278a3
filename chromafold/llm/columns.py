"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the end of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with the table's."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unpacked(df: DataFrame, row: str = "row", **replaced: Column) -> list[Column]:
    """The columns of a struct made by ``whole_row``, some of them replaced."""
    return [replaced.get(c, F.col(row).getField(c)).alias(c) for c in df.schema[row].dataType.names]
