"""Mutual-information quantization: features of a color share a code where that costs little information.

Per color the features, and the null that stands for their absence, are ordered by their share of negatives;
splits of that order become quanta. A color's split gains depend on its own splits only and never grow, so the
global greedy choice is the best ``slots`` of all colors' greedy lists: each color is worked on alone and one
top-k merges them. Equal shares are merged before that, as a split never pays inside a run of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromafold.operators.encoders import Dictionary, class_sketch, class_totals, sparse_budget
from chromafold.sources.lineage import hold

NULL = -1  # fid of the null of color c is NULL - c
LEAST_GAIN = 1e-12


def with_nulls(sketch: DataFrame, colors: DataFrame, totals: DataFrame) -> DataFrame:
    """(color, fid, pos, neg): all features and, per color, the lines without any of them; empty items are left out."""
    items = sketch.join(colors.select("fid", "color"), "fid").select("color", "fid", "pos", "neg")
    all_ = totals.select(F.col("pos").alias("p"), F.col("neg").alias("n"))
    rest = items.groupBy("color").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).join(F.broadcast(all_))  # one row
    nulls = rest.select("color", (F.lit(NULL) - F.col("color")).cast("int").alias("fid"), (F.col("p") - F.col("pos")).alias("pos"), (F.col("n") - F.col("neg")).alias("neg"))
    return items.unionByName(nulls).where(F.col("pos") + F.col("neg") > 0)


def cumulative(items: DataFrame) -> DataFrame:
    """(color, fid, at, neg, cnt, cum_neg, cum_cnt): positions from 1 by share of negatives, then fid."""
    cnt = F.col("pos") + F.col("neg")
    order = Window.partitionBy("color").orderBy(F.col("neg") / cnt, "fid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return items.select("color", "fid", F.row_number().over(order).alias("at"), "neg", cnt.alias("cnt"), F.sum("neg").over(upto).alias("cum_neg"), F.sum(cnt).over(upto).alias("cum_cnt"))


class Intervals:
    """Greedy splitting of one color's cumulative counts (with a leading zero)."""

    def __init__(self, counts: np.ndarray, negatives: np.ndarray, share: float):
        self.c, self.g, self.share, self.total = counts.astype(float), negatives.astype(float), share, float(counts[-1])

    def _h(self, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        p = c - g
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(g > 0, g * np.log(np.where(g > 0, g, 1) / np.where(c > 0, c, 1) / self.share), 0.0)
            b = np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(c > 0, c, 1) / (1 - self.share)), 0.0)
        return (a + b) / self.total

    def gains(self, lo: int, hi: int) -> np.ndarray:
        """The gain of a split at each position inside (lo, hi)."""
        i = np.arange(lo + 1, hi)
        parts = self._h(self.c[i] - self.c[lo], self.g[i] - self.g[lo]) + self._h(self.c[hi] - self.c[i], self.g[hi] - self.g[i])
        whole = self._h(np.array([self.c[hi] - self.c[lo]]), np.array([self.g[hi] - self.g[lo]]))
        return np.maximum(parts - whole, 0.0)

    def gain(self, lo: int, i: int, hi: int) -> float:
        return float(self.gains(lo, hi)[i - lo - 1])

    def best(self, lo: int, hi: int) -> tuple[float, int, int, int] | None:
        if hi - lo < 2:
            return None
        found = self.gains(lo, hi)
        top = found.max()
        at = int(np.flatnonzero(found >= top - 1e-15)[-1])  # the larger position on ties
        return (float(found[at]), lo + 1 + at, lo, hi) if found[at] > LEAST_GAIN else None

    def greedy(self, most: int) -> list[tuple[float, int]]:
        """(gain, position) of up to ``most`` splits in the order taken."""
        open_: list[tuple[float, int, int, int]] = []
        out: list[tuple[float, int]] = []

        def push(lo: int, hi: int) -> None:
            if found := self.best(lo, hi):
                heapq.heappush(open_, tuple(-x for x in found))

        push(0, len(self.c) - 1)
        while open_ and len(out) < most:
            gain, at, lo, hi = (-x for x in heapq.heappop(open_))
            out.append((gain, at))
            push(lo, at)
            push(at, hi)
        return out

    def marginal(self, splits: list[int]) -> list[tuple[float, int]]:
        """(gain, position) of each split given all others."""
        ends = [0, *sorted(splits), len(self.c) - 1]
        return [(self.gain(ends[k - 1], ends[k], ends[k + 1]), ends[k]) for k in range(1, len(ends) - 1)]


def split_candidates(items: DataFrame, totals: tuple[int, int], most: int, by_marginal: bool) -> DataFrame:
    """(color, at, gain): each color's greedy splits; ``at`` is a position of ``cumulative``'s order."""
    share = totals[1] / (totals[0] + totals[1])
    cum = cumulative(items)
    ratio = F.round(F.col("neg") / F.col("cnt"), 12)
    merged = cum.groupBy("color", ratio.alias("ratio")).agg(F.max("at").alias("at"), F.max("cum_neg").alias("cum_neg"), F.max("cum_cnt").alias("cum_cnt"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        at = frame["at"].to_numpy()
        splitter = Intervals(np.concatenate([[0], frame["cum_cnt"].to_numpy()]), np.concatenate([[0], frame["cum_neg"].to_numpy()]), share)
        found = splitter.greedy(most)
        if by_marginal:
            found = splitter.marginal([i for _, i in found])
        return pd.DataFrame({"color": np.int32(frame["color"].iloc[0]), "at": np.array([at[i - 1] for _, i in found], np.int32), "gain": np.array([g for g, _ in found], float)})

    return merged.groupBy("color").applyInPandas(one, "color int, at int, gain double")


def fit_quantizer(features: DataFrame, lines: DataFrame, colors: DataFrame, budget: int, ndense: int = 0, kind: str = "sm", budget_slack: int = 0) -> Dictionary:
    """Quanta by the global greedy choice (kinds sm and sn) or by marginal gains of per-color choices (ss and ns).

    The callers of sm and ss pass estimation lines only. At most ``budget`` quanta; ``budget_slack`` allows more.
    """
    totals = class_totals(lines)
    pos, neg = totals.first()
    if not pos or not neg:
        raise ValueError("both classes must occur")
    items = hold(with_nulls(class_sketch(features, lines), colors, totals))
    ncolors = items.select("color").distinct().count()
    slots = sparse_budget(budget, ndense) - ncolors + budget_slack
    if slots < 0:
        raise ValueError(f"{ncolors} colors do not fit the budget")
    marginal = kind in ("ss", "ns")
    splits = split_candidates(items, (pos, neg), slots + 1 if marginal else slots, marginal)
    chosen = splits.orderBy(F.col("gain").desc(), F.col("color").desc(), F.col("at").desc()).limit(slots).select("color", "at", F.lit(1).alias("cut"))
    placed = cumulative(items).join(chosen, ["color", "at"], "left")
    before = Window.partitionBy("color").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    interval = placed.select("color", "fid", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("part"))
    sizes = interval.groupBy("color").agg((F.max("part") + 1).alias("n"))
    first = Window.orderBy("color").rowsBetween(Window.unboundedPreceding, -1)  # one row per color
    starts = sizes.select("color", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("start"))
    table = hold(interval.join(F.broadcast(starts), "color").select("fid", "color", (F.col("start") + F.col("part")).cast("int").alias("quantum")))
    width = (table.agg(F.max("quantum")).first()[0] or 0) + 1
    dims = lines.sparkSession.range(width).select(F.col("id").cast("int").alias("idx"), F.lit(1).alias("dim"))
    return Dictionary(kind, table, dims, width)


def first_gains(items: DataFrame, totals: DataFrame) -> DataFrame:
    """(color, fid, gain): the gain of a first split after each item, in column expressions."""
    from chromafold.functions.features import information_term

    cum = cumulative(items)
    whole = cum.groupBy("color").agg(F.max("cum_cnt").alias("m"), F.max("cum_neg").alias("all_neg")).select(F.col("color").alias("c"), "m", "all_neg")
    share = totals.select((F.col("neg") / (F.col("pos") + F.col("neg"))).alias("share"))
    rows = cum.join(whole, F.col("color") == F.col("c")).join(F.broadcast(share)).where("cum_cnt < m")
    m, c, g = F.col("m"), F.col("cum_cnt"), F.col("cum_neg")
    gain = information_term(m, c, g, F.col("share")) + information_term(m, m - c, F.col("all_neg") - g, F.col("share")) - information_term(m, m, F.col("all_neg"), F.col("share"))
    return rows.select("color", "fid", F.greatest(gain, F.lit(0.0)).alias("gain"))


def entropy_bound(totals: tuple[int, int]) -> float:
    """The most information any encoding can give, in nats."""
    n = sum(totals)
    return -sum(k / n * math.log(k / n) for k in totals if k)
