import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chromafold.llm.packing import Packer, fill_window, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_sum(items, room):
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fill_window_is_optimal():
    rnd = random.Random(3)
    for _ in range(300):
        items = [rnd.randint(1, 60) for _ in range(rnd.randint(0, 8))]
        counts = {x: items.count(x) for x in items}
        room = rnd.randint(0, 120)
        taken, slack = fill_window(counts, sorted(counts, reverse=True), room)
        assert all(0 < n <= counts[x] for x, n in taken.items())
        assert room - slack == sum(x * n for x, n in taken.items()) == best_sum(items, room)


@pytest.mark.parametrize("seed", range(5))
def test_packer_covers_each_token_once(seed):
    rnd = random.Random(seed)
    lens = {i: rnd.choice([rnd.randint(1, 40), rnd.randint(1, 400)]) for i in range(300)}
    packer, pieces = Packer(64), []
    for doc, n in lens.items():
        pieces += packer.add(doc, n)
        if packer.tokens > 900:
            pieces += packer.pack(300)
    pieces += packer.finish()
    check(lens, pieces, 64)


def check(lens, pieces, capacity):
    by_doc, by_seq = {}, {}
    for doc, start, n, seq, off in pieces:
        by_doc.setdefault(doc, []).append((start, n))
        by_seq.setdefault(seq, []).append((off, n))
    for doc, total in lens.items():
        at = 0
        for start, n in sorted(by_doc[doc]):
            assert start == at and n > 0
            at += n
        assert at == total
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_pack_matches_the_tokenizer(spark):
    texts = ["", None, "Hello  WORLD it's\tfine", "a" * 3000, "naïve İstanbul ΣΣ x y  z <|endoftext|> done",
             "é café \x1c odd\x85", "same", "same", " ".join(f"w{i}" for i in range(6000))]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "no id", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, start int").repartition(2)
    out = pack(df, PATH, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    check({i: len(x) for i, x in want.items()}, [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in out], 4096)
    for r in out:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == piece and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())


def test_pack_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
