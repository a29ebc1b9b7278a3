import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from chromafold.llm import resemblance
from chromafold.llm.components import components
from chromafold.llm.resemblance import one_of_each

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def survivors(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def fixture():
    rnd = random.Random(11)
    vocabulary = [f"Wort{i}" for i in range(2000)]
    texts = ["", None, "one", "One", "a b c d e", "a b c d e f", "x x x x x x x x x"]
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 250))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            near = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 40)):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            texts.append("\n".join(near).upper())
    rnd.shuffle(texts)
    return [(i, t, "de", "h", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [512, 2])
def test_survivors_match_brute_force(spark, block):
    rows = fixture()
    out = one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    assert sorted(r.doc_id for r in out.collect()) == survivors(rows)


def test_the_stage_finds_copies_of_similarity_above_0_8(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        near = list(base)
        for at in (20, 70, 120):  # 15 of 196 shingles differ
            near[at] = "changed"
        rows += [(2 * k, " ".join(base), "en", "h", 1), (2 * k + 1, " ".join(near), "en", "h", 1)]
        assert 0.8 <= similarity(shingles(rows[-1][1]), shingles(rows[-2][1])) < 0.9
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [2 * k for k in range(30)]


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in one_of_each(df).collect()), key=str) == [(4, "a b c d e f"), (None, "z")]
    assert one_of_each(df.limit(0)).collect() == []


def test_fingerprints_are_majority_bits():
    texts = ["", "a b c", " ".join(f"w{i % 700}" for i in range(900)), "a b c d e f"]
    values, at = resemblance.shingle_sets(pa.array(texts), 5)
    prints = resemblance.wide_prints(values, at)
    full = [values[s:e] for s, e in zip(at[:-1], at[1:], strict=True) if e > s]
    assert prints.shape == (len(full), resemblance.WORDS)
    for got, shingles in zip(prints, full, strict=True):
        for word in range(resemblance.WORDS):
            hashes = [int(h) for h in resemblance.shingle_bits(shingles, word)]
            assert int(got[word]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def posted(print_, size):
    """(list, (carried word, second word)) of one fingerprint, by its definition."""
    word = [x.to_bytes(8, "little") for x in print_]
    shifts = resemblance.TINY_SHIFTS if size <= resemblance.TINY else resemblance.SHIFTS
    return [((t, k, word[(k + t + 1) % len(word)][t]), (word[k], word[k - len(word) // 2])) for t in range(shifts) for k in range(len(word))]


def near(x, y):
    shared = sum(a == b for a, b in zip(x, y, strict=True))
    return shared >= resemblance.SHARED and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= resemblance.BITS


def within(x, y, bits):
    return sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= bits


@pytest.mark.parametrize("limit,many,second", [(None, 1 << 20, 64), (5, 1 << 20, 64), (None, 0, resemblance.MORE_BITS), (5, 0, resemblance.MORE_BITS)])
def test_candidates_are_the_near_pairs_of_the_posting_lists(spark, limit, many, second):
    rng = np.random.default_rng(6)
    prints, sizes = [], []
    for group in range(14):
        base = rng.integers(0, 2**64, resemblance.WORDS, dtype=np.uint64)
        for _ in range(int(rng.integers(1, 9))):
            flips = np.packbits(rng.random((resemblance.WORDS, 64)) < 0.11, axis=1, bitorder="little").view(np.uint64)[:, 0]
            prints.append([int(x) for x in base ^ flips])
            sizes.append(5 if group % 3 == 0 else 90)
    lists = {}
    for i, (p, n) in enumerate(zip(prints, sizes, strict=True)):
        for at, word in posted(p, n):
            lists.setdefault(at, []).append((i, word))
    want = list(range(len(prints)))
    for entries in lists.values():
        for i, x in entries:
            for j, y in entries:
                if i < j and want[i] != want[j] and near(x[0], y[0]) and within(x[1], y[1], second):
                    want = [min(want[i], want[j]) if k in (want[i], want[j]) else k for k in want]
    names = [int(x) for x in np.sort(rng.integers(-(2**63), 2**63, len(prints)))]
    signed = [[x - 2**64 if x >= 2**63 else x for x in p] for p in prints]
    table = spark.createDataFrame(list(zip(names, sizes, signed, strict=True)) + [(0, 0, [])], "fp long, n long, print array<long>")
    found = {r.vertex: r.root for r in components(resemblance.candidates(table.repartition(3), limit, many)).collect()}
    assert len(set(want)) < len(prints)
    assert [found.get(x, x) for x in names] == [names[k] for k in want]


@pytest.mark.parametrize("short,long", [(128, 1 << 14), (2, 1 << 14), (128, 2), (2, 2)])
def test_links_within_lists_match_brute_force(monkeypatch, short, long):
    monkeypatch.setattr(resemblance, "SHORT", short)
    monkeypatch.setattr(resemblance, "LONG", long)
    rng = np.random.default_rng(4)
    bases = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.packbits(rng.random((400, 64)) < 0.09, axis=1, bitorder="little").view(np.uint64)[:, 0]
    words = bases[rng.integers(0, 40, 400)] ^ flips
    key = np.sort(rng.integers(0, 6, 400))
    more = np.where(rng.random(400) < 0.5, bases[0], bases[1])
    want = np.arange(400)
    for i in range(400):
        for j in range(i):
            if key[i] == key[j] and more[i] == more[j] and want[i] != want[j] and near(int(words[i]).to_bytes(8, "little"), int(words[j]).to_bytes(8, "little")):
                want[np.isin(want, [want[i], want[j]])] = min(want[i], want[j])
    a, b = resemblance.stars(*(x.astype(np.uint64) for x in resemblance.linked(key, words, more)))
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [got.get(i, i) for i in range(400)] == want.tolist()


def test_pairs_at_0_8_meet_in_a_list():
    rng = np.random.default_rng(8)
    for common, left, right in [(4, 0, 1), (12, 1, 2), (160, 20, 20)]:
        sets = []
        for _ in range(1000):
            x = rng.integers(0, 2**64, common + left + right, dtype=np.uint64)
            sets += [x[: common + left], np.concatenate([x[:common], x[common + left :]])]
        prints = resemblance.wide_prints(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        a, b = prints[0::2], prints[1::2]
        close = resemblance.near(a ^ b)
        hit = np.zeros(1000, bool)
        for t in range(resemblance.TINY_SHIFTS if common + max(left, right) <= resemblance.TINY else resemblance.SHIFTS):
            bytes_ = [np.roll(x, -t - 1, axis=1).view(np.uint8).reshape(1000, -1, 8)[:, :, t] for x in (a, b)]
            hit |= (close & (bytes_[0] == bytes_[1])).any(1)
        assert hit.sum() >= 995
        assert (resemblance.tally(a ^ b).sum(1) >= resemblance.LEAST).all()
        assert (np.bitwise_count(a ^ b).sum(1) <= resemblance.MOST).all()
