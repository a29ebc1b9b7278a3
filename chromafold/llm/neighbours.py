"""Approximate nearest neighbours by collision counting over sorted single projections.

Rows are dealt into blocks by a hash of their id, and so are the queries; each pair of a row block and a query
block is one unit of work. Within it every projection is a sorted array of the block's rows. A query opens a
window around its own projection in each array; virtual rehashing widens all windows by ``step`` until enough
is found. A row inside at least ``share`` of the windows is verified by its exact cosine. A query ends when its
``k`` best verified rows lie within the radius the windows stand for; if the widest windows do not end it,
all rows of the block are verified. The units' best rows are merged by query. No number of candidates is capped.

Equal vectors of a block are one entry that lists its ``k + 1`` smallest ids, all that ties can ever return.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do
rows without an id; vectors of other lengths than the query's are not its candidates; of rows that share an id
the one with the smallest vector counts; ties go to the smaller id; an empty table gives an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two, so that squares neither overflow nor vanish; cosines stay the same."""
    _, exponent = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors.astype(np.float64), -exponent[:, None])


class Block:
    """Sorted projections of one block's distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, projections: int = 128, width: float = 2.4, share: float = 0.77, step: float = 1.2, seed: int = 5):
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(ids) else order
        ids, vectors = ids[order], vectors[order]
        _, at, same = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        by = np.lexsort((ids, same.ravel()))
        first = np.searchsorted(same.ravel()[by], np.arange(len(at)))
        count = np.diff(np.append(first, len(by)))
        self.members = [ids[by[s : s + min(n, k + 1)]] for s, n in zip(first, count, strict=True)]
        self.vectors = scaled(vectors[at])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.k, self.width, self.step = k, width, step
        self.least = math.ceil(share * projections)
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], projections))
        place = (self.vectors / self.norms[:, None]) @ self.lines
        self.order = np.argsort(place, axis=0, kind="stable").T.astype(np.int32).copy()
        self.values = np.sort(place, axis=0).T.copy()

    def search(self, queries: np.ndarray, radius: float = 0.25) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query vector the verified entries and their cosines: at least its k nearest found."""
        q = scaled(queries)
        norms = np.sqrt((q * q).sum(1))
        centre = (q / norms[:, None]) @ self.lines
        radii = [radius]
        while radii[-1] < 2:
            radii.append(radii[-1] * self.step)
        low, high = [], []
        for r in radii:
            half = self.width * r / 2
            low.append(np.stack([np.searchsorted(v, c - half, "left") for v, c in zip(self.values, centre.T, strict=True)]))
            high.append(np.stack([np.searchsorted(v, c + half, "right") for v, c in zip(self.values, centre.T, strict=True)]))
        n = len(self.norms)
        for i in range(len(q)):
            hits = np.zeros(n, np.int32)
            cosines = np.full(n, -np.inf)
            seen = np.zeros(n, bool)
            a = b = None
            for r, lo, hi in zip(radii, low, high, strict=True):
                new_a, new_b = lo[:, i], hi[:, i]
                parts = []
                for line, (x, y) in enumerate(zip(new_a.tolist(), new_b.tolist(), strict=True)):
                    if a is None:
                        parts.append(self.order[line, x:y])
                    else:
                        parts += [self.order[line, x : a[line]], self.order[line, b[line] : y]]
                hits += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
                a, b = new_a.tolist(), new_b.tolist()
                fresh = np.flatnonzero((hits >= self.least) & ~seen)
                self._verify(q[i], norms[i], fresh, cosines, seen)
                inside = cosines >= 1 - r * r / 2 - 1e-12  # unit vectors at distance r have this cosine
                if sum(len(self.members[j]) for j in np.flatnonzero(inside)[: self.k + 1]) > self.k:
                    break
            else:
                self._verify(q[i], norms[i], np.flatnonzero(~seen), cosines, seen)
            found = np.flatnonzero(seen)
            yield found, cosines[found]

    def _verify(self, query: np.ndarray, norm: float, rows: np.ndarray, cosines: np.ndarray, seen: np.ndarray) -> None:
        if len(rows):
            cosines[rows] = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * norm)
            seen[rows] = True

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(query, row, cosine) of each query's k best rows in this block, itself left out."""
        if not len(queries):
            return
        distinct, same = np.unique(queries, axis=0, return_inverse=True)
        found = list(self.search(distinct))
        for qid, s in zip(query_ids.tolist(), same.ravel().tolist(), strict=True):
            rows, cosines = found[s]
            top = np.argsort(-cosines, kind="stable")
            if len(top) > self.k + 1:
                top = np.flatnonzero(cosines >= cosines[top[self.k]])
            hits = [(-c, i) for r, c in zip(rows[top].tolist(), cosines[top].tolist(), strict=True) for i in self.members[r].tolist() if i != qid]
            for c, i in sorted(hits)[: self.k]:
                yield qid, i, -c


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``queries`` holds its k nearest other rows by cosine."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    base = base.where(F.col("id").isNotNull() & usable(F.col("v"))).select("*", F.size("v").alias("dim"))
    n, n_asked = base.agg(F.count("*"), F.count_if("asked")).first()
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_asked / query_rows))
    place = F.xxhash64("id")
    kept = base.select("dim", F.pmod(place, F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(False).alias("asked"), "id", "v")
    sent = base.where("asked").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(place, F.lit(groups)).cast("int").alias("g"), "asked", "id", "v")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept.unionAll(sent).repartition(parts, "b", "g", "dim").sortWithinPartitions("b", "g", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def unit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids = t["id"].to_numpy()
            vectors = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            ask = t["asked"].to_numpy(zero_copy_only=False).astype(bool)
            out: list[tuple] = []
            if ask.any() and not ask.all():
                qids, at = np.unique(ids[ask], return_index=True)
                q = vectors[ask]
                if len(qids) < len(q):  # rows that share an id: the smallest vector
                    order = np.lexsort((*q.T[::-1], ids[ask]))
                    at = order[np.unique(ids[ask][order], return_index=True)[1]]
                out = list(Block(ids[~ask], vectors[~ask], k).nearest(qids, q[at]))
            columns = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_pydict({c: pa.array(x, y) for c, x, y in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "g", "dim")])
            edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e == s:
                    continue
                now = tuple(key[:, s].tolist())
                if held and now != last:
                    yield unit(held)
                    held = []
                last = now
                held.append(batch.slice(s, e - s))
        if held:
            yield unit(held)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
