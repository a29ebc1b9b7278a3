import numpy as np
import pytest
from pyspark.sql import functions as F

from chromafold.llm.neighbours import Block, search
from chromafold.llm.queries import op7_neighbours

SF = "/root/testdata/sf0.1"


def brute(rows, k, every):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            v = np.array(v, np.float32)
            if i not in usable or tuple(v) < tuple(usable[i]):
                usable[i] = v
    out = {}
    for q, v in usable.items():
        if q % every == 0:
            v = v.astype(float)
            hits = []
            for i, w in usable.items():
                if i != q and len(w) == len(v):
                    w = w.astype(float)
                    hits.append((-(w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())), i))
            if hits:
                out[q] = sorted(hits)[:k]
    return out


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 5, 50)
    got = {}
    for r in op7_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
        exact = {i: -c for c, i in want[q]}
        hits += sum(i in exact for _, i, _ in found)
        assert all(abs(s - exact[i]) < 1e-12 for _, i, s in found if i in exact)
    assert hits >= 0.95 * 5 * len(want), hits / (5 * len(want))


@pytest.mark.parametrize("block_rows,query_rows", [(16384, 4096), (20, 7)])
def test_edge_cases_match_brute_force(spark, block_rows, query_rows):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)], 1.0) for i in range(100)]
    same = [0.5, 0.25, 0.0, 1.0]
    rows += [(100 + i, same, 0.0) for i in range(40)]
    rows += [(200, None, 0.0), (202, [], 0.0), (204, [0.0] * 4, 0.0), (206, [1.0, None, 0.0, 0.0], 0.0), (208, [float("nan"), 1.0, 0.0, 0.0], 0.0), (210, [float("inf"), 1.0, 0.0, 0.0], 0.0)]
    rows += [(300, [1.0, 2.0], 0.0), (301, [2.0, 1.0], 0.0), (310, [1.0], 0.0), (None, same, 0.0), (100, same, 0.0), (50, [9.0, 9.0, 9.0, 9.0], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(3)
    got = {}
    for r in search(df, F.col("vec_id") % 10 == 0, block_rows=block_rows, query_rows=query_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 5, 10)
    assert set(got) == set(want)
    right = total = 0
    for q, found in got.items():
        found = [(i, s) for _, i, s in sorted(found)]
        assert len(found) == len(want[q])
        right += len({i for i, _ in found} & {i for _, i in want[q]})
        total += len(found)
        if 100 <= q < 140:
            assert [i for i, _ in found] == [i for _, i in want[q]]
    assert right >= 0.95 * total
    assert search(df.limit(0), F.lit(True)).collect() == []


def test_most_rows_are_never_verified(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    seen = [len(found) for found, _ in Block(ids, vectors, 5).search(vectors[ids % 50 == 0])]
    assert np.median(seen) < 0.2 * len(rows)


def test_components_of_any_size(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [1.0, 1.0 + 1e-12]), (3, [-1.0, 0.0])]
    got = [(r.vec_id, round(r.score, 9)) for r in sorted(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])]
    assert got == [(2, 1.0), (1, round(3 / 10**0.5, 9)), (3, round(-(0.5**0.5), 9))]


def test_widest_windows_fall_back_to_all_rows():
    block = Block(np.arange(3), np.array([[1, 0], [0, 1], [-1, 0]], np.float32), k=5)
    assert [(i, round(c, 6)) for _, i, c in block.nearest(np.array([7]), np.array([[1, 0.0]], np.float32))] == [(0, 1.0), (1, 0.0), (2, -1.0)]
