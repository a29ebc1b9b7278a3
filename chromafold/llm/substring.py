"""Substring deduplication by suffix automata of reference shards.

``repeated_spans`` removes every word covered by a run of ``length`` words that starts anywhere else in the
corpus. The reference is the corpus itself, so its automata cannot be broadcast whole; they are made of
shards that hold all passages able to match each other, and passages are sent to their shard:

1. *Anchors.* Each run of ``length`` words is assigned to the smallest hash among its word grams of half its
   length (leftmost on ties). The choice depends on the run alone, so equal runs have equal anchors.
   Neighbouring runs with one anchor form a passage, whose runs are exactly those assigned to it.
2. *Shards.* Passages whose anchor occurs once in the corpus are dropped: they cannot repeat. The different
   passages of any other anchor, with how often each occurs, are the reference shard of that anchor: a suffix
   automaton of all of them, in which each is streamed for its matching statistics; maximal stretches of runs of
   at least ``length`` words that the automaton holds twice are removed wherever that passage stands.
3. An anchor with more than ``shard_limit`` different passages is cut into shards of equal runs, counted by
   a partial aggregate, so that no group is held in one task; it removes what the automaton would.

Equal texts are worked on once: their runs all repeat. Symbols are 64-bit word hashes, texts are told apart
by 80 bits of hash. ``ReferenceShards`` matches documents against a given reference by broadcast automata.

Defined cases: null text has no words; texts shorter than ``length`` words lose nothing; repeated rows are
copies of each other; very long texts are read whole; equally small grams anchor at the leftmost; null ids are carried; an empty table gives an empty result; other input columns are
kept by ``remove_spans`` and ignored by ``repeated_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.llm.arrowtext import gram_hashes, mix, powers, slices, text_buffers, word_hashes, words
from chromafold.llm.automaton import SuffixAutomaton
from chromafold.llm.lineage import written

RUN_BITS, START_BITS = 8, 40  # a passage packed into 64 bits: 16 bits of text hash, first run, runs - 1


def passages(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All passages of a batch of rows: row, first run (word index in the batch), last run, anchor hash, content hash."""
    none = np.zeros(0, np.int64)
    half = (length + 1) // 2
    grams = gram_hashes(hashes, half)
    width = length - half + 1  # grams per run
    if len(grams) < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    value, place = grams, np.arange(len(grams))

    def narrow(shift: int) -> None:
        nonlocal value, place
        later = value[shift:] < value[: len(value) - shift]
        value = np.where(later, value[shift:], value[: len(value) - shift])
        place = np.where(later, place[shift:], place[: len(place) - shift])

    done = 1
    while done * 2 <= width:
        narrow(done)
        done *= 2
    if done < width:
        narrow(width - done)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(place)]
    runs = np.flatnonzero(np.arange(len(place)) + length <= first[row + 1])
    if not len(runs):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = place[runs]
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(runs) != 1)])
    start = runs[new]
    stop = runs[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]
    up, down = powers().get(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])
    content = mix((sums[stop + length] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row[start], start, stop, grams[anchor[new]], content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t"), F.xxhash64(F.lit(7), text).bitwiseAND(0xFFFF).cast("long").alias("u")]


def _anchors(keyed: DataFrame, length: int) -> DataFrame:
    """(h, c, t, p) of every passage: anchor, content, text and packed place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                s, e, first = words(data, offsets)
                row, start, stop, h, c = passages(word_hashes(data, s, e), first, length)
                t, u = (part.column(k).to_numpy(zero_copy_only=False)[row] for k in "tu")
                p = u << (RUN_BITS + START_BITS) | (start - first[row]) << RUN_BITS | (stop - start)
                yield pa.RecordBatch.from_pydict({"h": _signed(h), "c": _signed(c), "t": pa.array(t), "p": pa.array(p)})

    return keyed.mapInArrow(run, "h long, c long, t long, p long")


def _place(p: Column) -> list[Column]:
    start = F.shiftright(p, RUN_BITS).bitwiseAND((1 << START_BITS) - 1)
    return [F.shiftrightunsigned(p, RUN_BITS + START_BITS).alias("u"), start.alias("a"), (start + p.bitwiseAND((1 << RUN_BITS) - 1)).alias("b")]


def _match_shards(rows: DataFrame, length: int) -> DataFrame:
    """(h, c, i, j): the repeated runs i to j of each passage (h, c), by the automaton of its anchor's shard.

    ``rows`` holds each different passage once, sorted by anchor, with how often it occurs (n).
    """
    def shard(group: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        for _, _, n, content in group:
            automaton.add(content, min(n, 2))
        for h, c, _, content in group:
            begin = None
            for run, size in enumerate(automaton.matches(content, 2), 1 - length):
                if size >= length and begin is None:
                    begin = run
                elif size < length and begin is not None:
                    yield h, c, begin, run - 1
                    begin = None
            if begin is not None:
                yield h, c, begin, len(content) - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else ((),) * 4
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip("hcij", columns, strict=True)})

        for batch in batches:
            found: list[tuple] = []
            for record in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "n", "content")), strict=True):
                if group and group[0][0] != record[0]:
                    found += shard(group)
                    group = []
                group.append(record)
            yield out(found)
        if group:
            yield out(list(shard(group)))

    return rows.mapInArrow(run, "h long, c long, i long, j long")


def repeated_spans(texts: DataFrame, keyed: DataFrame, length: int, shard_limit: int = 256) -> DataFrame:
    """(t, u, a, b): ranges of runs (by first word) that occur more than once among distinct texts.

    ``keyed`` has text, t, u for every row, ``texts`` the same for every distinct text.
    """
    spark = texts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.xxhash64("t", "p")
    often = _anchors(keyed, length).groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    often = often.select(F.col("h").alias("again")).repartition(parts)  # keeps the join's shuffle splittable
    found = _anchors(keyed, length)
    found = found.join(often, found.h == often.again, "left_semi")
    turned = F.bitwise_not("h").alias("x")  # a key that the join is not dealt by, so that its hot anchors can be split
    found = found.select(turned, "c", "t", "p").groupBy("x", "c", "t", "p").agg(F.lit(1).alias("one"))
    found = written(found.select(F.bitwise_not("x").alias("h"), "c", "t", "p"))
    kinds = written(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("t", "p")).alias("at")))
    several = kinds.groupBy("h").agg(F.count("*").alias("m")).select(F.col("h").alias("mh"), "m").repartition(parts)
    wanted = kinds.join(several, kinds.h == several.mh).select("h", "c", "n", "m", F.col("at.t").alias("t"), *_place(F.col("at.p")))
    wanted = wanted.groupBy("t", "u").agg(F.collect_list(F.struct("h", "c", "n", "m", "a", "b")).alias("wanted"))
    near = texts.join(wanted, ["t", "u"]).select("text", "wanted")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                s, e, first = words(data, offsets)
                hashes = word_hashes(data, s, e)
                rows = {k: [] for k in ("h", "c", "n", "i", "x", "y")}
                content: list[np.ndarray | None] = []
                for wanted_, begin in zip(part.column("wanted").to_pylist(), first.tolist(), strict=False):
                    for w in wanted_:
                        some = hashes[begin + w["a"] : begin + w["b"] + length]
                        if w["m"] <= shard_limit:
                            runs = [(None, None)]
                        else:  # a shard for each run, named by two hashes
                            runs = list(zip(gram_hashes(some, length).view(np.int64).tolist(), gram_hashes(mix(some), length).view(np.int64).tolist(), strict=True))
                        for i, (x, y) in enumerate(runs):
                            for k, v in zip(rows, (w["h"], w["c"], w["n"], i, x, y), strict=True):
                                rows[k].append(v)
                            content.append(some.view(np.int64) if x is None else None)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()} | {"content": pa.array(content, pa.list_(pa.int64()))})

    held = written(near.mapInArrow(contents, "h long, c long, n long, i long, x long, y long, content array<long>"))
    shards = held.where("content is not null").select("h", "c", "n", "content").repartition(parts, "h").sortWithinPartitions("h")
    runs = held.where("content is null").select("h", "c", "n", "i", "x", "y")
    twice = runs.groupBy("x", "y").agg(F.sum("n").alias("k")).where("k > 1").select(F.col("x").alias("tx"), F.col("y").alias("ty")).repartition(parts)
    split = runs.join(twice, (runs.x == twice.tx) & (runs.y == twice.ty), "left_semi").select("h", "c", "i", F.col("i").alias("j"))
    again = _match_shards(shards, length).unionAll(split).select(F.col("h").alias("sh"), F.col("c").alias("sc"), "i", "j")
    placed = found.join(again, (found.h == again.sh) & (found.c == again.sc)).select("t", *_place(F.col("p")), "i", "j")
    return placed.select("t", "u", (F.col("a") + F.col("i")).alias("a"), (F.col("a") + F.col("j")).alias("b"))


def _cut(raw: bytes, s: np.ndarray, e: np.ndarray, gone: np.ndarray) -> tuple[str, str]:
    """The kept words joined by one space, hashed; and the text with each removed stretch cut out."""
    kept = np.flatnonzero(~gone)
    digest = hashlib.sha256(b" ".join(raw[i:j] for i, j in zip(s[kept].tolist(), e[kept].tolist(), strict=True))).hexdigest()
    if len(kept) == len(gone):
        return digest, raw.decode("utf-8")
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    pieces = [raw[s[i] : e[j - 1]] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return digest, b"\n".join(pieces).decode("utf-8")


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, shard_limit: int = 256,
                 with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256; ``with_text`` gives all columns of ``docs``, the text without the spans, and these."""
    if not 2 <= length <= 2 << RUN_BITS:
        raise ValueError(f"length must be from 2 to {2 << RUN_BITS}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(text.alias("text")).select("text", *text_key(F.col("text")))
    texts = keyed.groupBy("t", "u").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    spans = repeated_spans(texts, keyed, length, shard_limit)
    spans = spans.groupBy("t", "u").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = texts.join(spans, ["t", "u"], "left").select("t", "u", "text", "copies", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                s, e, first = words(data, offsets)
                raw = data.tobytes()
                n, gone_n, digests, kept = [], [], [], []
                for i, (copies, found) in enumerate(zip(part.column("copies").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                    begin, end = int(first[i]), int(first[i + 1])
                    size = end - begin
                    edge = np.zeros(size + 1, np.int64)
                    if copies > 1 and size >= length:
                        edge[0] = 1
                    elif found:
                        np.add.at(edge, [x["a"] for x in found], 1)
                        np.add.at(edge, [x["b"] + length for x in found], -1)
                    gone = np.cumsum(edge)[:size] > 0
                    digest, left = _cut(raw[offsets[i] : offsets[i + 1]], s[begin:end] - offsets[i], e[begin:end] - offsets[i], gone)
                    n.append(size)
                    gone_n.append(int(gone.sum()))
                    digests.append(digest)
                    kept.append(left)
                columns = {"t": part.column("t"), "u": part.column("u"), "n_words": pa.array(n, pa.int64()),
                           "n_removed": pa.array(gone_n, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    schema = "t long, u long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    done = joined.mapInArrow(run, schema)
    result = done.select(F.col("t").alias("_t"), F.col("u").alias("_u"), *(F.col(c).alias(f"_{c}") for c in done.columns[2:]))
    t, u = text_key(text)
    measures = [F.col(f"_{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")]
    if not with_text:
        rows = docs.select(F.col(id_col).alias("doc_id"), t, u)
        return rows.join(result, (rows.t == result["_t"]) & (rows.u == result["_u"])).select("doc_id", *measures)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names, strict=True)), t, u)
    text_at = names[docs.columns.index(text_col)]
    rows = rows.withColumn(text_at, F.col(text_at).isNull())  # the text itself need not travel again
    joined = rows.join(result, (rows.t == result["_t"]) & (rows.u == result["_u"]))
    kept = F.when(~F.col(text_at), F.col("_kept"))
    columns = [(kept if x == text_at else F.col(x)).alias(c) for c, x in zip(docs.columns, names, strict=True)]
    return joined.select(*columns, *(m for m, c in zip(measures, ("n_words", "n_removed", "kept_sha256"), strict=True) if c not in docs.columns))


class ReferenceShards:
    """Suffix automata of a given reference, broadcast shard by shard.

    Each shard holds at most ``shard_words`` words (a longer text is cut into overlapping parts), so what is
    broadcast at a time has a known bound; documents are streamed past one shard after another.
    """

    def __init__(self, texts: list[str], length: int = 35, shard_words: int = 200_000):
        self.length, self.shards = length, []
        room, automaton = 0, None
        for text in texts:
            data = np.frombuffer((text or "").encode(), np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]))
            symbols = word_hashes(data, s, e).tolist()
            for at in range(0, max(1, len(symbols)), shard_words):
                part = symbols[at : at + shard_words + length - 1]
                if automaton is None or room < len(part):
                    automaton, room = SuffixAutomaton(), shard_words + length
                    self.shards.append(automaton)
                automaton.add(part)
                room -= len(part)

    def matcher(self) -> Callable[[str], list[tuple[int, int]]]:
        shards, length = self.shards, self.length

        def spans(text: str | None) -> list[tuple[int, int]]:
            """Maximal (first, last + 1) word spans covered by runs of the reference."""
            data = np.frombuffer((text or "").encode(), np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]))
            symbols = word_hashes(data, s, e).tolist()
            gone = np.zeros(len(symbols) + 1, np.int64)
            for automaton in shards:
                for at, size in enumerate(automaton.matches(symbols)):
                    if size >= length:
                        gone[at + 1 - length] += 1
                        gone[at + 1] -= 1
            covered = np.concatenate([[0], (np.cumsum(gone) > 0).astype(np.int8)])
            edges = np.flatnonzero(np.diff(covered))
            return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=False))

        return spans
