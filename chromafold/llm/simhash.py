"""SimHash near-duplicate classes through a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most ``max_bits`` bits differ in at most
``max_bits`` bytes, so they share at least 8 - max_bits positional bytes, and at least r of the first
r + max_bits positions. The index posts each distinct fingerprint under every r-subset of those positions
with the bytes found there; fingerprints that meet in a posting list have their shared positional bytes
tallied, pairs below the guaranteed minimum are dropped, and the rest are verified bit by bit. r grows with
the number of fingerprints so that lists stay short; each choice of r finds every link.

A list of ordinary size is compared in one task, which emits a spanning forest of its links. A list longer
than ``list_limit`` is cut into blocks whose pairs are compared in tasks of their own, so no list is ever
dropped, capped or held whole.

Defined cases: null and word-less texts have fingerprint zero and link like any other; repeated rows and
equal texts share a fingerprint; very long texts are read whole; a bit set in exactly half of the hashes is 0; a class is named by its smallest non-null id (null if it has none); an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromafold.llm.arrowtext import slices, text_buffers
from chromafold.llm.columns import unpacked, whole_row
from chromafold.llm.components import components
from chromafold.llm.lineage import hold

BYTES = 8


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: bit i is set if it is set in over half of their hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    spans = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                fps = [fingerprint(raw[s:e], shingle) for s, e in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def tally(difference: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs share, from the exclusive or of their fingerprints."""
    return BYTES - np.bitwise_count((((difference & _LOW) + _LOW) | difference) & _HIGH)


def verified(difference: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share the guaranteed number of positional bytes and, of those, differ in few enough bits."""
    keep = np.flatnonzero(tally(difference) >= BYTES - max_bits)
    return keep[np.bitwise_count(difference.ravel()[keep]) <= max_bits]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links among (a, b) that join parts not yet joined."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _matrix(left: np.ndarray, right: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks, compared in strips."""
    found_a, found_b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.divmod(verified(left[at : at + step, None] ^ right[None, :], max_bits), len(right))
        found_a, found_b = forest(np.concatenate([found_a, left[at + i]]), np.concatenate([found_b, right[j]]))
    return found_a, found_b


SHORT = 48


def _lists(fps: np.ndarray, begin: np.ndarray, end: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists: list k is fps[begin[k]:end[k]]."""
    out_a, out_b = [], []
    size = end - begin
    short = size <= SHORT
    last = np.repeat(end[short], size[short])
    rows = np.repeat(begin[short] - np.cumsum(size[short]) + size[short], size[short]) + np.arange(int(size[short].sum()))
    for d in range(1, int(size[short].max()) if short.any() else 0):
        rows, last = rows[rows + d < last], last[rows + d < last]
        a, b = fps[rows], fps[rows + d]
        ok = verified(a ^ b, max_bits)
        out_a.append(a[ok])
        out_b.append(b[ok])
    for s, e in zip(begin[~short].tolist(), end[~short].tolist(), strict=True):
        a, b = _matrix(fps[s:e], fps[s:e], max_bits)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _arrow(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "key": pa.array(key)})


def similar(fps: DataFrame, max_bits: int = 4, list_limit: int = 2048, target_list: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a spanning forest of each posting list's links.

    Their components are those of all pairs that differ in at most ``max_bits`` bits.
    """
    n = fps.count()
    r = next((r for r in (2, 3) if n <= target_list * 256**r), BYTES - max_bits)
    keys = []
    for k, places in enumerate(combinations(range(r + max_bits), r)):
        found = F.lit(k)
        for p in places:
            found = found * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
        keys.append(found.cast("long"))
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = posted.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_k, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def lists(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            end = np.concatenate([begin[1:], [len(k)]])
            some = (end - begin > 1) & (end - begin <= list_limit)
            a, b = _lists(f, begin[some], end[some], max_bits)
            if len(a):
                a, b = forest(a, b)
                yield _arrow(a, b, np.full(len(a), -1, np.int64))
            for s, e in zip(begin[end - begin > list_limit].tolist(), end[end - begin > list_limit].tolist(), strict=True):
                yield _arrow(f[s:e], f[s:e], k[s:e])  # a long list: handed on

        for batch in batches:
            k = np.concatenate([kept_k, batch.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([kept_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if len(k) - cut > 4 * list_limit:  # surely a long list: hand on what is held of it, in sorted order
                yield _arrow(f[cut:-1], f[cut:-1], k[cut:-1])
                yield from lists(k[:cut], f[:cut])
                kept_k, kept_f = np.full(list_limit + 1, k[-1]), np.full(list_limit + 1, f[-1])
                continue
            yield from lists(k[:cut], f[:cut])
            kept_k, kept_f = k[cut:], f[cut:]
        yield from lists(kept_k, kept_f)

    found = hold(posted.mapInArrow(run, "a long, b long, key long"))
    links = found.where("key < 0").select("a", "b")
    long_lists = found.where("key >= 0").select("key", F.col("a").alias("fp")).distinct()
    if long_lists.isEmpty():
        return links
    blocks = long_lists.groupBy("key").agg(F.ceil(F.count("*") / list_limit).cast("int").alias("n"))
    placed = long_lists.join(F.broadcast(blocks), "key") if blocks.count() <= 10_000 else long_lists.join(blocks, "key")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    spread = placed.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
    spread = spread.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "mine")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list]] = {}

        def done(group: tuple) -> Iterator[pa.RecordBatch]:
            left, right = (np.array(x, np.int64).view(np.uint64) for x in held.pop(group))
            a, b = _matrix(left, right if len(right) else left, max_bits)
            if len(a):
                yield _arrow(a, b, np.full(len(a), -1, np.int64))

        for batch in batches:
            for key, i, j, mine, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "mine", "fp")), strict=True):
                if (key, i, j) not in held:
                    for group in list(held):
                        yield from done(group)
                    held[key, i, j] = [], []
                held[key, i, j][int(mine != i)].append(fp)
        for group in list(held):
            yield from done(group)

    return links.unionAll(spread.mapInArrow(compare, "a long, b long, key long").select("a", "b"))


def named(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(of, name) for every row of ``distinct`` (fp, first): the smallest ``first`` of its component of ``links``."""
    parts = distinct.sparkSession.sparkContext.defaultParallelism
    roots = components(links)
    rooted = hold(distinct.join(roots, distinct.fp == roots.vertex, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first").alias("name")).repartition(parts)  # keeps the join's shuffle splittable
    return rooted.select("fp", "root").join(names, "root").select(F.col("fp").alias("of"), "name").repartition(parts)


def classes(signed: DataFrame, max_bits: int = 4) -> DataFrame:
    """(of, name) for every distinct fingerprint of ``signed``: the smallest doc_id of its class."""
    distinct = hold(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return named(distinct, similar(distinct.select("fp"), max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    signed = hold(fingerprints(docs, id_col, text_col, shingle))
    classed = classes(signed, max_bits)
    return signed.join(classed, signed.fp == classed.of).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("name").alias("component_id"))


def kept_rows(docs: DataFrame, classed: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name a class in ``classed`` (of, name), given the table (at, text) of keys and texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h"))
    kept = classed(docs.select(key.alias("at"), F.col(text_col).alias("text"))).select("name").distinct()
    rows = docs.select(whole_row(docs).alias("row"), key.alias("at"))
    rows = rows.join(kept, F.col("at") == F.col("name"), "left_semi").dropDuplicates(["at"])  # one shuffle of the texts
    return rows.select(*unpacked(rows))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The row of ``docs`` with the smallest id of each class, all columns unchanged.

    Rows without an id never stand for a class that has one; of rows that share id and text, any one stays.
    """
    return kept_rows(docs, lambda keyed: classes(hold(fingerprints(keyed, "at", "text", shingle)), max_bits), id_col, text_col)
