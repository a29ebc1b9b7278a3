import random
import re

import pytest
import xxhash

from chromafold.llm.components import components
from chromafold.llm.simhash import near_duplicates, similar


def reference_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts():
    rnd = random.Random(5)
    vocabulary = [f"Wörd{i}" for i in range(300)]
    out = ["", None, "   ", "one", "one", "one two three", "A b C d", "a B c D"]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 150))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            near = list(base)
            near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            out.append("\n".join(near))
    return out


def test_classes_match_brute_force(spark):
    rows = [(i + 10, t, "noise", 1) for i, t in enumerate(texts())]
    rnd = random.Random(1)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(3)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    rows.sort()
    fps = [reference_fp(t) for _, t, *_ in rows]
    root = brute_components(fps)
    assert len(got) == len(rows)
    for (i, *_), fp, at in zip(rows, fps, root, strict=True):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == rows[at][0]


@pytest.mark.parametrize("list_limit,target_list", [(2048, 4), (3, 4), (64, 0), (5, 10**-7)])
def test_links_match_brute_force(spark, list_limit, target_list):
    rnd = random.Random(9)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 60)):
            fps.add(base)
            base ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 5)))
            base &= 2**64 - 1
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = similar(spark.createDataFrame([(f,) for f in signed], "fp long"), list_limit=list_limit, target_list=target_list)
    roots = {r.vertex: r.root for r in components(links).collect()}
    want = brute_components(fps)
    groups, got = {}, {}
    for i, f in enumerate(signed):
        groups.setdefault(want[i], set()).add(f)
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == [(4, 4), (4, 4), (None, 4), (None, None)]
    assert near_duplicates(df.limit(0)).collect() == []
