"""Sequence packing by minimum bin slack.

Documents are tokenised and packed inside the task that reads them, so nothing is shuffled and memory is
bounded by a pool of tokens. Each window is anchored on the longest remaining piece; a bitset subset-sum
dynamic programme over the multiset of remaining lengths finds the combination that fills the window
closest to its capacity, and the counts of each length are backtracked from the stored bitsets. What no
combination can fill is filled by cutting one more piece. What is left at the end of a task becomes
windows whose lengths are powers of two, so no window needs padding.

Defined cases: null text counts as empty (one end-of-document token); null ids are carried; repeated rows
are packed as separate documents; a document longer than a window is cut, however long; of equal lengths the
earlier document goes first; an empty table gives no pieces; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromafold.llm.arrowtext import slices, text_buffers
from chromafold.llm.wordcache import tokenizer_words

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill_window(counts: dict[int, int], order: list[int], room: int) -> tuple[dict[int, int], int]:
    """The sub-multiset of ``counts`` (lengths, tried in ``order``) whose sum is closest to ``room`` from below.

    Returns how many of each length are taken, and the slack that is left. Bit s of the bitset is set when
    some combination of the lengths seen so far sums to s.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        if length > room or not counts.get(length):
            continue
        steps.append((length, reach))
        left, part = min(counts[length], room // length), 1
        while left:  # binary splitting of the count
            part = min(part, left)
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    taken: dict[int, int] = {}
    rest = target
    for length, before in reversed(steps):
        n = 0
        while not before >> rest & 1:
            rest -= length
            n += 1
        if n:
            taken[length] = n
    return taken, room - target


class Packer:
    """Packs a stream of documents; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.by_length: dict[int, list[tuple[object, int]]] = {}
        self.counts: dict[int, int] = {}
        self.tokens = 0

    def _put(self, doc: object, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.counts[length] = self.counts.get(length, 0) + 1
        self.tokens += length

    def _take(self, length: int) -> tuple[object, int]:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.tokens -= length
        return self.by_length[length].pop()

    def add(self, doc: object, n: int) -> Iterator[tuple]:
        start = 0
        while n - start >= self.capacity:  # whole windows of a long document
            yield doc, start, self.capacity, self.sequence, 0
            self.sequence += 1
            start += self.capacity
        if n > start:
            self._put(doc, start, n - start)

    def pack(self, until: int) -> Iterator[tuple]:
        """Fill windows while more than ``until`` tokens (at least a window's worth) remain."""
        order = sorted(self.counts, reverse=True)
        while self.tokens >= max(until, self.capacity):
            order = [x for x in order if x in self.counts] if len(order) > 2 * len(self.counts) else order
            longest = next(x for x in order if x in self.counts)
            doc, start = self._take(longest)
            chosen, room = [(doc, start, longest)], self.capacity - longest
            taken, slack = fill_window(self.counts, order, room)
            for length, n in taken.items():
                chosen += [(*self._take(length), length) for _ in range(n)]
            if slack:  # every remaining piece is longer than the slack: cut one
                length = next(x for x in order if x in self.counts)
                doc, start = self._take(length)
                chosen.append((doc, start, slack))
                self._put(doc, start + slack, length - slack)
                if length - slack not in order:
                    order = sorted(self.counts, reverse=True)
            at = 0
            for doc, start, length in chosen:
                yield doc, start, length, self.sequence, at
                at += length
            self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """Pack all that remains; the last, short part becomes windows of power-of-two lengths."""
        yield from self.pack(0)
        sizes = [1 << b for b in range(self.tokens.bit_length() - 1, -1, -1) if self.tokens >> b & 1]
        rest = [(d, s, n) for n in sorted(self.by_length, reverse=True) for d, s in self.by_length[n]]
        at, room = 0, sizes.pop(0) if sizes else 0
        for doc, start, length in rest:
            while length:
                n = min(length, room)
                yield doc, start, n, self.sequence, at
                start, length, at, room = start + n, length - n, at + n, room - n
                if not room:
                    self.sequence, at, room = self.sequence + 1, 0, sizes.pop(0) if sizes else 0
        self.by_length, self.counts, self.tokens = {}, {}, 0


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
         end_id: int = 2, pool_tokens: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: where its document and its sequence hold it, and the CRC-32 of its ids.

    ``pool_tokens`` bounds the tokens a task holds before it fills windows; ``with_ids`` adds the ids.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind.simpleString()}, {PIECES}" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_words(tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        packer, id_type = Packer(capacity), None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            docs_, starts, lens, seqs, offs = zip(*rows, strict=True)
            parts = [d[1][s : s + n] for d, s, n in zip(docs_, starts, lens, strict=True)]
            columns = {
                "doc_id": pa.array([d[0] for d in docs_], id_type),
                "start": pa.array(starts, pa.int64()), "length": pa.array(lens, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                "doc_tokens": pa.array([len(d[1]) for d in docs_], pa.int64()),
                "sequence_id": pa.array([base + s for s in seqs], pa.int64()), "offset": pa.array(offs, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            rows.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                raw = data.tobytes()
                for doc_id, s, e in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ids = np.append(words.ids(raw[s:e]), np.uint32(end_id))
                    rows.extend(packer.add((doc_id, ids), len(ids)))
                    if len(rows) > 5000:
                        yield out()
                if packer.tokens > pool_tokens:
                    rows.extend(packer.pack(pool_tokens // 4))
                    if rows:
                        yield out()
        rows.extend(packer.finish())
        if rows:
            yield out()

    return source.mapInArrow(run, schema)
