"""Greedy coloring of the co-occurrence graph, its distributed form, removal orders and sampled colorings.

Vertices are colored by falling degree (ties by id), each with the smallest color its colored neighbours leave
free; colors are then renumbered by falling class size. The sequential form runs on the driver for graphs of at
most ``driver_edges`` edges (a checked count). Larger graphs stay distributed: the driver holds a few numbers a
vertex and at most about ``driver_edges`` edges at a time, and gives the same colors and orders.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromafold.operators import graph
from chromafold.sources.lineage import written

DRIVER_EDGES = 4_000_000
PIECES = 8  # tasks that read one block of edges
WORD = 63  # colors in one signed 64-bit mask


class Adjacency:
    """Neighbour lists of a graph held in memory: those of vertex v are others[start[v]:start[v + 1]]."""

    def __init__(self, n: int, left: np.ndarray, right: np.ndarray):
        keys = np.concatenate([left, right], dtype=np.int64)  # one array of 64-bit numbers, changed in place
        keys *= max(1, n)
        keys[: len(left)] += right
        keys[len(left) :] += left
        keys.sort()
        self.start = np.searchsorted(keys, np.arange(n + 1) * max(1, n))
        keys %= max(1, n)
        self.others = keys.astype(np.int32)
        self.degree = np.diff(self.start)
        self.n = n

    def neighbours(self, v: int) -> np.ndarray:
        return self.others[self.start[v] : self.start[v + 1]]


def _ends(edges: DataFrame) -> DataFrame:
    """The two ends of every edge, written once."""
    return written(edges.select(F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r")))


def _collected(rows: DataFrame) -> list[np.ndarray]:
    """The columns of ``rows`` on the driver."""
    return [c.to_numpy() for c in rows.toArrow().columns]


def collect_graph(edges: DataFrame, n: int, limit: int = DRIVER_EDGES) -> Adjacency:
    """A graph of at most ``limit`` edges, on the driver."""
    edges = _ends(edges)
    if edges.count() > limit:
        raise ValueError(f"more than {limit} edges: use the distributed form")
    return Adjacency(n, *_collected(edges))


def _by_degree(degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices by falling degree (ties by id), and the place of each."""
    order = np.lexsort((np.arange(len(degree)), -degree))
    place = np.empty(len(degree), np.int32)
    place[order] = np.arange(len(degree), dtype=np.int32)
    return order, place


def _extend(colors: array, taken: list[int], late: np.ndarray, early: np.ndarray) -> None:
    """Appends the colors of the next ``len(taken)`` places: the smallest one that neither the mask nor an earlier end has."""
    order = np.argsort(late, kind="stable")
    at = np.searchsorted(late[order], np.arange(len(colors), len(colors) + len(taken) + 1)).tolist()
    early = early[order]
    for k, mask in enumerate(taken):
        for u in early[at[k] : at[k + 1]].tolist():
            mask |= 1 << colors[u]
        colors.append((~mask & (mask + 1)).bit_length() - 1)


def greedy(adjacency: Adjacency) -> np.ndarray:
    """Colors by falling degree, renumbered by falling class size."""
    _, place = _by_degree(adjacency.degree)
    late, early = np.repeat(place, adjacency.degree), place[adjacency.others]
    before = early < late
    colors = array("i")
    _extend(colors, [0] * adjacency.n, late[before], early[before])
    return by_class_size(np.array(colors, np.int64)[place])


def by_class_size(colors: np.ndarray) -> np.ndarray:
    if not len(colors):
        return colors
    sizes = np.bincount(colors)
    rank = np.empty(len(sizes), np.int64)
    rank[np.lexsort((np.arange(len(sizes)), -sizes))] = np.arange(len(sizes))
    return rank[colors]


def _frame(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(np.asarray(v, np.int32)) for k, v in columns.items()}))


def _degrees(edges: DataFrame, n: int) -> np.ndarray:
    """The degree of every vertex, on the driver."""
    return _tallied(edges.select(F.explode(F.array("l", "r")).alias("fid")), n)


def _tallied(rows: DataFrame, n: int) -> np.ndarray:
    """How often each of the vertices 0 to n - 1 is in column fid."""
    out = np.zeros(n, np.int64)
    fid, count = _collected(rows.groupBy("fid").agg(F.count("*").alias("n")))
    out[fid] = count
    return out


def colors_along(edges: DataFrame, place: np.ndarray, degree: np.ndarray, block_edges: int) -> np.ndarray:
    """The greedy colors of the places 0, 1, ..., in that order; ``place`` is each vertex's, ``degree`` each place's.

    Places are cut into blocks of at most ``2 * block_edges`` ends (or one place), so that no block holds over
    ``block_edges`` edges in itself. Tasks reduce the edges between a block and earlier ones to masks of the colors that
    are taken; the driver gets these and the block's own edges and colors it.
    """
    spark = edges.sparkSession
    block = (np.cumsum(degree, dtype=np.int64) - 1) // (2 * block_edges)
    bounds = np.flatnonzero(np.diff(block, prepend=-2))
    known = spark.sparkContext.broadcast((place, bounds))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bounds = known.value
        for batch in batches:
            a, b = (place[batch.column(c).to_numpy()] for c in ("l", "r"))
            late = np.maximum(a, b)
            of = (np.searchsorted(bounds, late, "right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"late": pa.array(late), "early": pa.array(np.minimum(a, b)), "piece": pa.array(late % np.int32(PIECES)), "block": pa.array(of)})

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = edges.select("l", "r").mapInArrow(deal, "late int, early int, piece int, block int")
    dealt = written(dealt.repartition(parts, "block", "piece").sortWithinPartitions("block", "late").drop("piece"), "block")
    colors = array("i")
    for b, (first, end) in enumerate(zip(bounds.tolist(), [*bounds[1:].tolist(), len(degree)], strict=True)):
        late, at, bits = _collected(_taken(dealt.where(F.col("block") == b), np.array(colors, np.int32)))
        taken = [0] * (end - first)
        for v, w, x in zip((late[at >= 0] - first).tolist(), at[at >= 0].tolist(), bits[at >= 0].tolist(), strict=True):
            taken[v] |= x << (WORD * w)
        _extend(colors, taken, late[at < 0], bits[at < 0])
    known.destroy()
    return np.array(colors, np.int64)


def _taken(edges: DataFrame, colors: np.ndarray) -> DataFrame:
    """(late, at, bits): masks of the colors of earlier ends that have one (word ``at``), and other earlier ends as they are (``at`` -1)."""
    shared = edges.sparkSession.sparkContext.broadcast(colors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        colors = shared.value
        for batch in batches:
            late, early = (batch.column(c).to_numpy() for c in ("late", "early"))
            done = early < len(colors)
            word, bit = np.divmod(colors[early[done]].astype(np.int64), WORD)
            key = late[done].astype(np.int64) << 26 | word
            order = np.argsort(key, kind="stable")
            key, bit = key[order], np.int64(1) << bit[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            masks = np.bitwise_or.reduceat(bit, begin) if len(begin) else bit
            rest = ~done
            yield pa.RecordBatch.from_pydict({
                "late": pa.array(np.concatenate([(key[begin] >> 26).astype(np.int32), late[rest]])),
                "at": pa.array(np.concatenate([(key[begin] & (1 << 26) - 1).astype(np.int32), np.full(int(rest.sum()), -1, np.int32)])),
                "bits": pa.array(np.concatenate([masks, early[rest].astype(np.int64)]))})

    return edges.select("late", "early").mapInArrow(run, "late int, at int, bits long")


def greedy_rounds(edges: DataFrame, vertices: DataFrame, block_edges: int = DRIVER_EDGES) -> DataFrame:
    """(fid, color) by blocks of vertices, a job each, over edges that stay distributed."""
    n = vertices.count()
    degree = _degrees(edges, n)
    order, place = _by_degree(degree)
    colors = by_class_size(colors_along(edges, place, degree[order], block_edges)[place])
    return written(_frame(edges.sparkSession, fid=np.arange(n), color=colors))


def color(edges: DataFrame, vertices: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(fid, color) of all vertices (ids 0 to n - 1)."""
    edges = _ends(edges)
    if edges.count() > driver_edges:
        return greedy_rounds(edges, vertices, driver_edges)
    n = vertices.count()
    colors = greedy(Adjacency(n, *_collected(edges)))
    return _frame(edges.sparkSession, fid=np.arange(n), color=colors)


def table_colors(vocab: DataFrame) -> DataFrame:
    """(col, fid, color) of tabular data: each categorical column is a color, numbered by name."""
    columns = vocab.select("col").distinct()
    ranks = columns.select("col", (F.row_number().over(Window.orderBy("col")) - 1).cast("int").alias("color"))  # one row per column
    return vocab.select("col", "fid").join(F.broadcast(ranks), "col")


def _peeled(adjacency: Adjacency, degree: np.ndarray, least: int = 0) -> np.ndarray:
    """Each vertex's degree when it is removed as one of largest remaining degree (ties by id); -1: below ``least`` by then.

    ``degree`` may count neighbours that ``adjacency`` lacks. Degrees only fall, so those removed at degree d are, by
    id, the ones of that degree that none before them has lowered.
    """
    now, at = degree.astype(np.int64), np.full(adjacency.n, -1, np.int64)
    while (top := int(now.max(initial=-1))) >= max(least, 1):
        for v in np.flatnonzero(now == top).tolist():
            if now[v] == top:
                at[v] = top
                now[adjacency.neighbours(v)] -= 1
                now[v] = -1  # and lower, as its neighbours go
    if least <= 0:
        at[now == 0] = 0
    return at


def _in_order(at: np.ndarray) -> np.ndarray:
    """The removed vertices in the order of removal: by falling degree then, ties by id."""
    gone = np.flatnonzero(at >= 0)
    return gone[np.argsort(-at[gone], kind="stable")]


def largest_first(adjacency: Adjacency) -> tuple[np.ndarray, np.ndarray]:
    """Vertices by repeated removal of one of largest remaining degree (ties by id), and those degrees."""
    at = _peeled(adjacency, adjacency.degree)
    order = _in_order(at)
    return order, at[order]


def discrete_cutoff(removed_degrees: np.ndarray) -> int:
    """The first position i with 2 * degree < i, else the number of vertices: those before it are masked."""
    below = np.flatnonzero(2 * removed_degrees < np.arange(len(removed_degrees)))
    return int(below[0]) if len(below) else len(removed_degrees)


def _chosen(edges: DataFrame, pick: np.ndarray, both: bool) -> DataFrame:
    """The edges whose ends are both picked, or (fid) the end with a 1 of those whose other end has a 2."""
    shared = edges.sparkSession.sparkContext.broadcast(pick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = shared.value
        for batch in batches:
            l, r = (batch.column(c).to_numpy() for c in ("l", "r"))
            a, b = pick[l], pick[r]
            if both:
                keep = (a > 0) & (b > 0)
                yield pa.RecordBatch.from_pydict({"l": pa.array(l[keep]), "r": pa.array(r[keep])})
            else:
                yield pa.RecordBatch.from_pydict({"fid": pa.array(np.concatenate([l[(a == 1) & (b == 2)], r[(a == 2) & (b == 1)]]))})

    return edges.select("l", "r").mapInArrow(run, "l int, r int" if both else "fid int")


def removals(edges: DataFrame, n: int, driver_edges: int = DRIVER_EDGES, enough: Callable[[np.ndarray], bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices in largest-first order, their degrees then, and the degrees of all in the whole graph.

    While over ``driver_edges`` edges are left, the vertices of the largest degrees, down to a bound that leaves few
    enough edges among them, are taken together: all that are removed until the largest degree falls below it are among
    them, so the edges among them decide their order. One pass then counts what the others lose. A single
    degree whose vertices have too many edges among themselves is decided in blocks. ``enough`` ends it after a prefix.
    """
    edges = _ends(edges)
    degree = _degrees(edges, n)
    now, at = degree.copy(), np.full(n, -1, np.int64)
    rows = left = int(degree.sum()) // 2
    done = False
    while left > driver_edges and not done:
        top = int(now.max())
        ends = np.cumsum((np.bincount(now[now > 0]) * np.arange(top + 1))[::-1])[::-1]  # of vertices of this degree or more
        few = np.flatnonzero(ends.astype(float) ** 2 <= 2.0 * left * driver_edges)  # half the bound, were edges drawn at random
        least = max(1, int(few[0])) if len(few) else top
        inner = written(_chosen(edges, (now >= least).astype(np.int8), True))
        while (held := inner.count()) > driver_edges and least < top:
            least = (least + top + 1) // 2
            inner = written(_chosen(inner, (now >= least).astype(np.int8), True))
        some = np.flatnonzero(now >= least)
        place = np.full(n, -1, np.int32)
        place[some] = np.arange(len(some), dtype=np.int32)
        if held > driver_edges:  # one degree: the first color by id is what is removed
            found = np.where(colors_along(inner, place, _degrees(inner, n)[some], driver_edges) == 0, top, -1)
        else:
            l, r = _collected(inner)
            found = _peeled(Adjacency(len(some), place[l], place[r]), now[some], least)
        at[some] = found
        pick = (now >= 0).astype(np.int8)
        pick[some[found >= 0]] = 2
        now -= _tallied(_chosen(edges, pick, False), n)
        now[at >= 0] = -1
        left = int(now[now > 0].sum()) // 2
        done = bool(enough and enough(at[_in_order(at)]))
        if 2 * left < rows and not done:
            edges, rows = written(_chosen(edges, (now > 0).astype(np.int8), True)), left
    if not done:
        some = np.flatnonzero(at < 0)
        place = np.full(n, -1, np.int32)
        place[some] = np.arange(len(some), dtype=np.int32)
        l, r = _collected(_chosen(edges, (at < 0).astype(np.int8), True))
        at[some] = _peeled(Adjacency(len(some), place[l], place[r]), now[some])
    order = _in_order(at)
    return order, at[order], degree


def removal_order(edges: DataFrame, vertices: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(position, fid, degree) of the largest-first order."""
    order, at, _ = removals(edges, vertices.count(), driver_edges)
    return _frame(edges.sparkSession, position=np.arange(len(order)), fid=order, degree=at)


def filtered_diagnostics(train: DataFrame, valid: DataFrame, vertices: DataFrame, n_train: int, n_valid: int, max_k: int, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Per k: the graph of edges seen k times or more, its hub vertices masked, and what that leaves.

    (k, cutoff, good_turing, new_edges, max_degree, avg_degree); frequencies are those of the whole graph, new
    edges and degrees those of the thresholded one without masked vertices. The order is followed to its cutoff only.
    """
    spark, n = train.sparkSession, vertices.count()
    train, valid = written(train), written(valid)
    out = []
    for k in range(1, max_k + 1):
        kept = graph.threshold(train, k)
        order, at, degree = removals(kept, n, driver_edges, lambda at: discrete_cutoff(at) < len(at))
        cutoff = discrete_cutoff(at)
        masked = F.broadcast(_frame(spark, fid=order[:cutoff]))  # about twice the root of the edges at most
        free = np.ones(n, bool)
        free[order[:cutoff]] = False
        mass = graph.without(train.where(F.col("freq") <= k), masked).agg(F.sum("freq")).first()[0] or 0
        unseen = graph.without(valid.join(kept.select("l", "r"), ["l", "r"], "left_anti"), masked).agg(F.sum("freq")).first()[0] or 0
        d = degree[free]
        out.append((k, cutoff, mass / n_train, unseen / n_valid, int(d.max()) if len(d) else 0, float(d.mean()) if len(d) else 0.0))
    return spark.createDataFrame(out, "k int, cutoff int, good_turing double, new_edges double, max_degree int, avg_degree double")


def glauber(adjacency: Adjacency, colors: int, masked: np.ndarray, seed: int = 1234) -> np.ndarray:
    """A sampled coloring: greedy, then single-vertex updates to a random color its free neighbours leave.

    Masked vertices (a boolean array) take no part and get colors of their own at the end.
    """
    now = greedy(adjacency)
    free = np.flatnonzero(~masked)
    if len(free) and now.max(initial=-1) >= colors:
        raise ValueError(f"the greedy coloring needs {now.max() + 1} colors, more than {colors}")
    rng = np.random.default_rng(seed)
    steps = int(adjacency.degree[free].max(initial=0)) * len(free)
    sites, draws = rng.integers(0, max(1, len(free)), steps), rng.random(steps)
    for s, u in zip(sites.tolist(), draws.tolist(), strict=True):
        v = free[s]
        around = adjacency.neighbours(v)
        taken = np.zeros(colors, bool)
        taken[now[around[~masked[around]]]] = True
        open_colors = np.flatnonzero(~taken)
        now[v] = open_colors[int(u * len(open_colors))]
    now[masked] = colors + np.arange(int(masked.sum()))
    return now


def glauber_colorings(spark: SparkSession, adjacency: Adjacency, color_counts: list[int], masked: np.ndarray) -> DataFrame:
    """(ncolors, fid, color): one seeded chain for each color count, run in parallel."""
    shared = spark.sparkContext.broadcast((adjacency, masked))

    def chains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c in frame["ncolors"].tolist():
                found = glauber(*(lambda a, m, c=c: (a, c, m))(*shared.value))
                yield pd.DataFrame({"ncolors": np.int32(c), "fid": np.arange(len(found), dtype=np.int32), "color": found.astype(np.int32)})

    counts = spark.createDataFrame([(c,) for c in color_counts], "ncolors int").repartition(max(1, len(color_counts)))
    return counts.mapInPandas(chains, "ncolors int, fid int, color int")
