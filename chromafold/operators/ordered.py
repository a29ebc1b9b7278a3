"""Sums along a total order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafold.sources.lineage import hold


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """``df`` with, under each name, the sum of its value over all rows before this one in a total order.

    Rows are dealt by range and summed inside their part; the parts' totals, one row each, are the only thing
    that reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = [f"_value_{name}" for name in values]
    placed = df.select("*", *(v.alias(h) for v, h in zip(values.values(), held, strict=True)))
    placed = hold(placed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = dict.fromkeys(held, 0)
    starts: dict[str, list[Column]] = {h: [] for h in held}
    for r in sorted(placed.groupBy("_part").agg(*(F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in held)).collect()):
        for h in held:
            starts[h] += [F.lit(r["_part"]), F.lit(before[h])]
            before[h] += r[h]
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def total(h: str) -> Column:
        start = F.element_at(F.create_map(*starts[h]), F.col("_part")) if starts[h] else F.lit(0)
        return F.coalesce(F.sum(h).over(inside), F.lit(0)) + start

    return placed.select("*", *(total(h).alias(name) for h, name in zip(held, values, strict=True))).drop("_part", *held)
