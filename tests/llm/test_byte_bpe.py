import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from chromafold.llm.byte_bpe import NONE, PairTable, encode, load_ranks, merge_long, pair_ranks, word_finder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(3)
    bits = [" ", "  ", "\u00a0", "\u2003", "\u3000", "\u2028", "\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "it's", "we'll", "'S", "Hello", "world", "été", "日本語", "😀👍", "123", "x1y2", "...", "%%%", "İ", "ß", "́", "<|endoftext|>", "a", "²", "Ⅷ", "_"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    vocabulary = [t.decode("utf-8", "ignore") for t in list(load_ranks(PATH))[::23]]
    return [None, "", " ", "\n\n", "a" * 3000, "ab" * 700 + " c", "%" * 600, " " * 900 + "x", "é" * 400, " ".join(vocabulary), "".join(vocabulary), *out, "dup dup", "dup dup"]


def test_matches_tiktoken(spark, reference):
    rows = [(i, t, 1, "y") for i, t in enumerate(texts())] + [(None, "no id", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, words string").repartition(3)
    for chunk, most, common in ((32 << 20, 10**6, 0), (500, 10**6, 10**5), (500, 40, 30)):
        got = encode(df, PATH, public_tokenizers.PATTERN, chunk_bytes=chunk, max_words=most, with_ids=True, common=common).collect()
        assert len(got) == len(rows)
        want = {i: t or "" for i, t, *_ in rows}
        for r in got:
            ids = reference.encode_ordinary(want[r.doc_id])
            assert r.ids == ids, want[r.doc_id][:80]
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert bytes(r.decoded) == want[r.doc_id].encode() and r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect() == []


def test_pair_table_is_perfect():
    pairs = pair_ranks(load_ranks(PATH))
    table = PairTable.build(pairs)

    assert all(table.rank(a, b) == r for (a, b), r in pairs.items())
    rnd = random.Random(0)
    for _ in range(20000):
        a, b = rnd.randrange(50256), rnd.randrange(50256)
        assert table.rank(a, b) == pairs.get((a, b), NONE)


def test_every_token_merges_to_itself():
    """So the fold needs no look-up of whole words."""
    ranks, find = load_ranks(PATH), word_finder(public_tokenizers.PATTERN)
    for token, rank in ranks.items():
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if find(text) == [text]:
            assert merge_long(token, ranks) == [rank]
