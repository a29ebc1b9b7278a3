"""Byte-level BPE: Spark higher-order functions fold ranked merges over the byte arrays of distinct words.

1. *Common words.* The words of a bounded sample of rows (``sample_rows`` on average) are counted; the
   ``common`` most frequent are folded once and broadcast with their ids, so that tasks need not fold them again.
   Which words these are changes the work, not the result.
2. Each task cuts its texts into the pattern's matches ("words"), numbers the distinct ones, and passes on one row
   per chunk of text (``chunk_bytes`` at most, but one text at least) with the words that are new to the task.
   After ``max_words`` words it starts afresh.
3. Spark folds the merges over each distinct word: an ``aggregate`` that merges the leftmost adjacent pair of lowest
   rank until none is left. Its state is one array of numbers, each a token with its place and the rank of the
   pair that it opens, so that the array's minimum is the next merge. The rank map is a literal: a perfect hash of
   pairs of ranks in two constant arrays, so that a lookup is arithmetic and two array reads. Decoding
   concatenates the binary pieces of a word's ids, read from a constant array of tokens.
4. The same task puts the words' ids and bytes back in the order of its texts.

Only the sample's counts are shuffled. Words of more than ``LONG`` bytes, for which a fold that copies its array at
every merge would take quadratic time, are merged with a priority queue instead; the result is the same.

Defined cases: null text counts as empty (no tokens); null ids are carried; repeated rows get equal results; very long
texts are taken whole, as a chunk of their own; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.llm.arrowtext import slices
from chromafold.llm.columns import let
from chromafold.llm.lineage import hold

LONG = 256
RANK_BITS, PLACE_BITS = 17, 20
NONE = 1 << RANK_BITS  # the rank of a pair that is no token
#: Fixed value: Unicode white space, as a character class; Python's and Java's own classes differ from it.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BUCKET_BITS, SLOT_BITS = 16, 17
_MIX, _STEP = 0x2545F491, 0x9E3779B1  # multipliers stay below 2**29: products of 34-bit keys stay below 2**63
_FREE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(rank of left, rank of right) -> rank of their concatenation, for every way to split a token in two."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


@dataclass
class PairTable:
    """A perfect hash: a pair's key picks a bucket, whose shift moves the key's slot; a slot holds key and rank."""

    shifts: list[int]
    slots: list[int]
    mix: int

    @classmethod
    def build(cls, pairs: dict[tuple[int, int], int]) -> PairTable:
        keys = [a << RANK_BITS | b for a, b in pairs]
        bits = max(SLOT_BITS, (len(keys) * 6 // 5).bit_length())
        members: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            members.setdefault(bucket(k), []).append(i)
        for mix in (k * _STEP % (1 << 29) | 1 for k in range(1, 200)):
            if all(len({slot(keys[i], 0, mix, bits) for i in some}) == len(some) for some in members.values()):
                break
        else:
            raise ValueError("no multiplier tells all pairs of a bucket apart")
        values, shifts, slots = list(pairs.values()), [0] * (1 << BUCKET_BITS), [_FREE] * (1 << bits)
        for b, some in sorted(members.items(), key=lambda x: -len(x[1])):
            shifts[b] = next(s for s in range(1 << bits) if all(slots[slot(keys[i], s, mix, bits)] == _FREE for i in some))
            for i in some:
                slots[slot(keys[i], shifts[b], mix, bits)] = keys[i] << RANK_BITS | values[i]
        return cls(shifts, slots, mix)

    def rank(self, left: int, right: int) -> int:
        """What the column expression of ``folded`` computes."""
        key = left << RANK_BITS | right
        return min(NONE, self.slots[slot(key, self.shifts[bucket(key)], self.mix, len(self.slots).bit_length() - 1)] ^ key << RANK_BITS)


def bucket(key: int) -> int:
    return key * _MIX >> 20 & (1 << BUCKET_BITS) - 1


def slot(key: int, shift: int, mix: int, bits: int) -> int:
    return (key * mix >> 22) + shift & (1 << bits) - 1


def _numbers(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def folded(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: the ids of each word of an array of byte arrays."""
    table = PairTable.build(pair_ranks(ranks))
    size = len(table.slots) - 1
    low_rank, by_place = NONE - 1, RANK_BITS + PLACE_BITS
    none = F.lit(NONE).cast("bigint")

    def with_tables(slots: Column, shifts: Column, singles: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            def look(key: Column) -> Column:
                shift = F.get(shifts, F.shiftright(key * _MIX, 20).bitwiseAND((1 << BUCKET_BITS) - 1).cast("int"))
                at = (F.shiftright(key * table.mix, 22) + shift).bitwiseAND(size).cast("int")
                return F.least(none, F.get(slots, at).bitwiseXOR(F.shiftleft(key, RANK_BITS)))  # the key's own slot leaves the rank

            return let(F.shiftleft(left, RANK_BITS).bitwiseOR(right), look)

        def opened(pair: Column, rest: Column) -> Column:
            return F.shiftleft(F.coalesce(pair, none), by_place).bitwiseOR(rest)

        def merge(a: Column, _: Column) -> Column:
            def at(low: Column) -> Column:
                return F.when(F.shiftright(low, by_place) >= NONE, a).otherwise(let(F.array_position(a, low).cast("int"), lambda p: join(low, p)))

            def join(low: Column, p: Column) -> Column:
                new, before, after = F.shiftright(low, by_place), F.get(a, p - 2), F.get(a, p + 1)
                place = low.bitwiseAND(((1 << PLACE_BITS) - 1) << RANK_BITS)
                mine = opened(rank(new, after.bitwiseAND(low_rank)), place.bitwiseOR(new))
                left = opened(rank(before.bitwiseAND(low_rank), new), before.bitwiseAND((1 << by_place) - 1))
                rest = F.slice(a, p + 2, F.size(a))
                return F.when(p > 1, F.concat(F.slice(a, F.lit(1), p - 2), F.array(left, mine), rest)).otherwise(F.concat(F.array(mine), rest))

            return let(F.array_min(a), at)

        def word(w: Column) -> Column:
            def token(b: Column, i: Column) -> Column:
                mine = F.get(singles, b)
                return opened(rank(mine, F.get(singles, F.get(w, i + 1))), F.shiftleft(i.cast("bigint"), RANK_BITS).bitwiseOR(mine))

            merged = F.aggregate(F.sequence(F.lit(2), F.size(w)), F.transform(w, token), merge)
            return F.when(F.size(w) > 1, F.transform(merged, lambda x: x.bitwiseAND(low_rank).cast("int"))).otherwise(F.transform(w, lambda b: F.get(singles, b).cast("int")))

        return F.transform(words, word)

    singles = [ranks[bytes([b])] for b in range(256)]
    return let(_numbers(table.slots, "bigint"), lambda x: let(_numbers(table.shifts, "bigint"), lambda y: let(_numbers(singles, "bigint"), lambda z: with_tables(x, y, z))))


def pieces(ids: Column, ranks: dict[bytes, int]) -> Column:
    """array<binary>: for each array of ids the concatenation of its tokens' bytes."""
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex()
    literal = F.transform(F.split(F.lit(",".join(tokens)), ","), lambda x: F.unhex(x))
    empty = F.lit("").cast("binary")
    return let(literal, lambda t: F.transform(ids, lambda w: F.aggregate(w, empty, lambda a, x: F.concat(a, F.get(t, x.cast("int"))))))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a queue of its adjacent pairs."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    queue: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (both := parts[i] + parts[j]) in ranks:
            heapq.heappush(queue, (ranks[both], i, both))

    for i in range(len(parts) - 1):
        push(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        push(before[i])
    return [ranks[p] for p in parts if p is not None]


def word_finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern, with white space spelled out."""
    spelled = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")
    return regex.compile(spelled).findall


class Numbered(dict):
    """Numbers keys in the order they are first asked for, from ``first`` on; ``new`` lists them."""

    def __init__(self, first: int):
        super().__init__()
        self.first, self.new = first, []

    def __missing__(self, key):
        self[key] = n = self.first + len(self.new)
        self.new.append(key)
        return n


def spelled(ids: pa.Array, digits: pa.Array) -> pa.Array:
    """For each list of ids their decimal forms, each with a space after it, as one value."""
    text = digits.take(ids.flatten())
    starts = np.frombuffer(text.buffers()[1], np.int64)[text.offset :]
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(starts[ends], np.int64)), text.buffers()[2]])


def digits_of(ranks: dict[bytes, int]) -> pa.Array:
    return pa.array([b"%d " % i for i in range(max(ranks.values()) + 1)], pa.large_binary())


def joined(values: pa.Array, at: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of the chosen values one after another, and where each begins (one entry more)."""
    found = values.take(at)
    data = found.buffers()[2]
    return memoryview(data if data is not None else b""), np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]


def byte_arrays(words: list[bytes]) -> pa.Array:
    """list<int>: the bytes of each word."""
    stops = np.cumsum([0, *map(len, words)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


def common_words(source: DataFrame, ranks: dict[bytes, int], pattern: str, rows: int, most: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The ``most`` most frequent words of about ``rows`` rows of (doc_id, text), their spelled ids and their bytes."""
    n = source.count()
    some = source.select("text").where("text is not null").sample(min(1.0, rows / max(1, n)), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = word_finder(pattern), Counter()

        def out() -> pa.RecordBatch:
            items = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in items], pa.string()), "n": pa.array([k for _, k in items], pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(find(text))
                if len(counts) > 50_000:
                    yield out()
        yield out()

    counted = some.mapInArrow(count, "word string, n long").where(F.octet_length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n"))
    best = hold(counted.orderBy(F.col("n").desc(), "word").limit(most).select("word"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = byte_arrays([w.encode() for w in batch.column("word").to_pylist()])
            at = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, batch.column("word")), pa.ListArray.from_arrays(at, words)], ["words", "w"])

    spread = best.repartition(source.sparkSession.sparkContext.defaultParallelism).mapInArrow(to_bytes, "words array<string>, w array<array<int>>")
    coded = spread.select("words", folded(F.col("w"), ranks).alias("ids"))
    table = coded.select("words", "ids", pieces(F.col("ids"), ranks).alias("bytes")).toArrow()
    words, ids, parts = (pa.concat_arrays(pc.list_flatten(table[c]).chunks or [pa.array([], table.schema.field(c).type.value_type)]) for c in ("words", "ids", "bytes"))
    return words.cast(pa.large_string()), spelled(ids, digits_of(ranks)), parts.cast(pa.large_binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 2 << 20, max_words: int = 100_000, with_ids: bool = False,
           sample_rows: int = 24_000, common: int = 250_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; ``with_ids`` adds ids and decoded bytes."""
    ranks = load_ranks(ranks_path)
    if odd := [t for t, rank in ranks.items() if merge_long(t, ranks) != [rank]]:
        raise ValueError(f"{len(odd)} tokens cannot be reached by merges")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    known, *coded_known = common_words(source, ranks, pattern, sample_rows, common)
    shared_words, shared_codes = context.broadcast(known), context.broadcast(coded_known)  # at most ``common`` words

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = word_finder(pattern), shared_words.value
        doc_ids: list[pa.Array] = []
        matches: list[pa.Array] = []
        lens: list[int] = []
        held, before, words = 0, 0, Numbered(len(known))

        def out() -> pa.RecordBatch:
            every = pa.concat_arrays([pa.array([], pa.large_string()), *matches])
            at = pc.index_in(every, value_set=known)
            other = every.filter(at.is_null()).dictionary_encode()
            seq = at.fill_null(-1).to_numpy().copy()
            numbers = np.fromiter(map(words.__getitem__, other.dictionary.to_pylist()), np.int32, len(other.dictionary))
            seq[seq < 0] = numbers[other.indices.to_numpy()]
            raw = [w.encode("utf-8") for w in words.new[before:]]
            table = pa.RecordBatch.from_arrays([pa.concat_arrays(doc_ids)], ["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table)
            longs = [(i, w) for i, w in enumerate(raw) if len(w) > LONG]
            short = byte_arrays([w if len(w) <= LONG else b"" for w in raw])
            columns = {"docs": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "lens": pa.array([np.array(lens, np.int64).tobytes()], pa.binary()),
                       "seq": pa.array([seq.tobytes()], pa.binary()),
                       "long": pa.array([longs], pa.list_(pa.struct([("i", pa.int32()), ("w", pa.binary())]))), "before": pa.array([before], pa.int32()),
                       "words": pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), short)}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                doc_ids.append(part.column("doc_id"))
                found = [find(text) if text else [] for text in part.column("text").to_pylist()]
                lens += map(len, found)
                matches.append(pa.array([w for ws in found for w in ws], pa.large_string()))
                held += matches[-1].nbytes
                if held >= 2 * chunk_bytes:  # the matches with their offsets take about twice the text
                    yield out()
                    doc_ids, matches, lens, held, before = [], [], [], 0, len(words.new)
                    pa.default_memory_pool().release_unused()
                    if before > max_words:  # both ends of the task forget what it has seen
                        before, words = 0, Numbered(len(known))
        if doc_ids:
            yield out()

    packed = source.mapInArrow(chunks, "docs binary, lens binary, seq binary, long array<struct<i:int,w:binary>>, before int, words array<array<int>>")
    coded = packed.select("docs", "lens", "seq", "long", "before", folded(F.col("words"), ranks).alias("ids"))
    coded = coded.select("*", pieces(F.col("ids"), ranks).alias("bytes"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_texts, known_parts = shared_codes.value
        digits, names = digits_of(ranks), {rank: t for t, rank in ranks.items()}
        texts, parts = known_texts, known_parts
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                words = row.column("ids").flatten()
                new_texts, new_parts = spelled(words, digits), row.column("bytes").flatten().cast(pa.large_binary())
                if longs := row.column("long")[0].as_py():
                    some_texts, some_parts = new_texts.to_pylist(), new_parts.to_pylist()
                    for x in longs:
                        ids = merge_long(x["w"], ranks)
                        some_texts[x["i"]], some_parts[x["i"]] = b"".join(b"%d " % k for k in ids), b"".join(names[k] for k in ids)
                    new_texts, new_parts = pa.array(some_texts, pa.large_binary()), pa.array(some_parts, pa.large_binary())
                if not row.column("before")[0].as_py():
                    texts, parts = known_texts, known_parts
                    pa.default_memory_pool().release_unused()
                texts, parts = pa.concat_arrays([texts, new_texts]), pa.concat_arrays([parts, new_parts])
                at = pa.array(np.frombuffer(row.column("seq")[0].as_buffer(), np.int32))
                stops = np.concatenate([[0], np.cumsum(np.frombuffer(row.column("lens")[0].as_py(), np.int64))])
                (spelling, a), (decoded, b) = joined(texts, at), joined(parts, at)
                a, b = a[stops].tolist(), b[stops].tolist()
                table = pa.ipc.open_stream(row.column("docs")[0].as_py()).read_all().combine_chunks()
                out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
                for s, e, x, y in zip(a, a[1:], b, b[1:], strict=False):
                    mine = spelling[s : max(s, e - 1)]
                    out["n_tokens"].append(int(np.count_nonzero(np.frombuffer(spelling[s:e], np.uint8) == 32)))
                    out["ids_sha256"].append(hashlib.sha256(mine).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded[x:y]).hexdigest())
                    if with_ids:
                        out["ids"].append([int(k) for k in bytes(mine).split()])
                        out["decoded"].append(bytes(decoded[x:y]))
                kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.binary()} if with_ids else {})
                column = table["doc_id"]
                column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                yield pa.RecordBatch.from_pydict({"doc_id": column} | {k: pa.array(out[k], t) for k, t in kinds.items()})

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return coded.mapInArrow(unpack, schema)
