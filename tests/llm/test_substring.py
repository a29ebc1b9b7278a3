import hashlib
import random
import re

import pytest

from chromafold.llm.automaton import SuffixAutomaton
from chromafold.llm.substring import ReferenceShards, remove_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length):
    docs = [WORD.findall(t or "") for t in texts]
    count = {}
    for w in docs:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus(seed, length):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)]
    passage = [[rnd.choice(vocabulary) for _ in range(rnd.randint(max(1, length - 2), 3 * length))] for _ in range(5)]
    texts = [None, "", " \t\n", "a " * (4 * length), "a b " * length, "c " * (length - 1), "c " * length]
    for _ in range(40):
        w = []
        for _ in range(rnd.randint(1, 4)):
            w += [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 2 * length))]
            if rnd.random() < 0.6:
                p = list(rnd.choice(passage))
                if rnd.random() < 0.3:
                    p[rnd.randrange(len(p))] = "changed"
                w += p[rnd.randint(0, 3) : len(p) - rnd.randint(0, 3)]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    return texts + texts[10:14] + [texts[12]] * 3


@pytest.mark.parametrize("seed,length,limit", [(1, 35, 256), (2, 35, 2), (3, 5, 256), (4, 8, 3), (5, 2, 4)])
def test_matches_brute_force(spark, seed, length, limit):
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, t string, n_words int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_spans(df, length=length, shard_limit=limit).collect()}
    want = dict(enumerate(brute(texts, length)))
    assert got == want


def test_text_keeps_spacing_and_columns(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"one\ntwo  {shared}\nafter  it", "x"), (2, f"{shared} zwei", "y"), (None, None, None), (3, "plain  text", "z"), (3, "plain  text", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = remove_spans(df, with_text=True)
    assert out.columns == ["doc_id", "text", "kept", "n_words", "n_removed", "kept_sha256"]
    got = sorted(((r.doc_id, r.text, r.kept, r.n_removed) for r in out.collect()), key=str)
    assert got == [(1, "one\ntwo\nafter  it", "x", 40), (2, "zwei", "y", 40), (3, "plain  text", "z", 0), (3, "plain  text", "z", 0), (None, None, None, 0)]
    assert remove_spans(df.limit(0)).collect() == []


def test_automaton_against_scan():
    rnd = random.Random(2)
    for _ in range(60):
        refs = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 4))]
        automaton = SuffixAutomaton()
        for r in refs:
            automaton.add(r)
        for k in (1, 2, 3):
            text = "".join(rnd.choice("abcd") for _ in range(15))
            occurs = lambda x: sum(r.startswith(x, i) for r in refs for i in range(len(r)))
            want = [max([n for n in range(1, i + 2) if occurs(text[i + 1 - n : i + 1]) >= k], default=0) for i in range(len(text))]
            assert list(automaton.matches(text, k)) == want


def test_reference_shards():
    rnd = random.Random(8)
    ref = [" ".join(f"v{rnd.randrange(500)}" for _ in range(n)) for n in (300, 90, 20)]
    w = [x.split() for x in ref]
    for shard_words in (50, 100, 10_000):
        spans = ReferenceShards([*ref, None], length=10, shard_words=shard_words).matcher()
        assert spans(" ".join(["x"] * 5 + w[0][100:140] + ["y"] + w[2][:9] + ["z"] + w[1][5:15])) == [(5, 45), (56, 66)]
        assert spans(None) == [] and spans("v1 v2") == []
