import math
import random

import numpy as np
from pyspark.sql import functions as F

from chromafold.llm.language import identify, train
from chromafold.llm.rules import STATISTICS, _split, classify, fit, holds, lasso, statistics
from chromafold.llm.queries import op4_language, op9_quality_classifier

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op4_language(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(i, t, k, 1.0) for i, (t, k) in enumerate([("the cat and the dog", "en")] * 30 + [("le chat et la souris été", "fr")] * 30)]
    rows += [(100, None, "en", 1.0), (101, "", "fr", 1.0), (102, "123 !!", None, 1.0), (103, "é", None, 1.0), (None, "the dog the cat", None, 1.0), (104, "LE CHAT et la " * 5000, None, 1.0), (104, "LE CHAT et la " * 5000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {}
    for r in identify(df).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert [got[i][0] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0][0] in ("en", "fr") and got[None][0][0] == "en"
    assert len(got[104]) == 2 and got[104][0] == got[104][1] and got[104][0][0] == "fr"
    assert {r.lang_pred for r in identify(df, reject_below=1.1).collect()} == {"und"}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}
    assert identify(df.limit(0)).collect() == []


def test_scores_match_sums_over_single_subwords():
    rnd = random.Random(5)
    texts = ["", "a", "ab", "Été 12!", "x" * 700, *("".join(rnd.choice("abc ÉÖ1") for _ in range(rnd.randint(0, 30))) for _ in range(40))]
    model = train(["le chat noir", "the black cat", "die katze"] * 20, ["fr", "en", "de"] * 20)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for row, r in zip(model.logits(data, offsets), raw, strict=True):
        fold = [b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in r.lower()] + [0x20] * 3
        total = np.zeros(3)
        for size in (2, 3, 4):
            for i in range(len(r)):
                key = 0
                for b in fold[i : i + size]:
                    key = key << 8 | b
                key = key * 0x9E3779B1 & 0xFFFFFFFF
                key = (key ^ key >> 15) * (0x85EBCA6B + 2 * size) & 0xFFFFFFFF
                total += model.table[key >> 32 - model.bits]
        assert np.allclose(row, total / max(1, 3 * len(r)) + model.bias, atol=1e-5)


def test_unsure_predictions_are_rejected(spark):
    rnd = random.Random(2)
    word = lambda s: "".join(rnd.choice(s) for _ in range(5))
    rows = [(i, " ".join(word("abcd" if i % 2 else "wxyz") for _ in range(8)), "l" if i % 2 else "r") for i in range(400)]
    rows += [(1000 + i, " ".join(word("klmn") for _ in range(8)), None) for i in range(20)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rejected_as=None).collect()}
    assert sum(got[i].rejected for i in range(400)) < 20 and sum(got[1000 + i].rejected for i in range(20)) > 15
    assert all(got[i].lang_pred in "lr" for i in got)


def test_calibration_lowers_the_loss_of_overconfident_scores():
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("abcd" if i % 2 else "abce") for _ in range(12)) for i in range(400)]
    model = train(texts, ["x" if i % 2 else "y" for i in range(400)], epochs=20)
    assert model.temperature > 0 and np.isfinite(model.table).all()
    data = np.frombuffer(b"abcdabcdabcd" b"abceabceabce", np.uint8)
    best, score = model.predict(data, np.array([0, 12, 24]))
    assert [model.languages[b] for b in best] == ["x", "y"] and (score <= 1).all()


def test_lasso_is_optimal():
    rng = np.random.default_rng(3)
    a = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2.5 * a[:, 0] - 2 * a[:, 1] + 0.2)))).astype(float)
    penalty = 0.02
    w, intercept = lasso(a, y, penalty, rounds=5000)

    def loss(w, b):
        z = a @ w + b
        return (np.logaddexp(0, z) - y * z).mean() + penalty * np.abs(w).sum()

    best = loss(w, intercept)
    assert 0 < (w != 0).sum() < 12 and w[0] > 0 > w[1]
    for j in range(12):  # no coordinate can be improved alone, which for a convex loss is the optimum
        for d in (-0.05, -0.01, 0.01, 0.05):
            moved = w.copy()
            moved[j] += d
            assert loss(moved, intercept) > best - 1e-6
    assert loss(w, intercept + 0.02) > best - 1e-6 and loss(w, intercept - 0.02) > best - 1e-6


def test_split_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, residual = rng.integers(0, 6, (40, 3)).astype(float), rng.normal(size=40)
        cuts = [np.arange(6) - 0.5] * 3
        best = max(((s := residual[x[:, j] <= at]).sum() ** 2 / len(s) + (o := residual[x[:, j] > at]).sum() ** 2 / len(o), -j, -at)
                   for j in range(3) for at in cuts[j] if 5 <= (x[:, j] <= at).sum() <= 35)
        got = _split(x, residual, cuts, 5)
        if got is None:
            assert best[0] <= residual.sum() ** 2 / 40 + 1e-6
        else:
            assert abs(got[0] - best[0]) < 1e-9


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op9_quality_classifier(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.93, right
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (1, None, 2), (2, "", 3), (2, "", 3), (3, "x " * 40000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(classify(docs, labels).collect()) == 5
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).collect() == []


def test_compiled_rules_match_numpy(spark):
    from chromafold.llm.rules import compiled

    rng = np.random.default_rng(0)
    x = rng.random((400, len(STATISTICS)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    rules, bias = fit(x, y)
    z = bias + sum(w * holds(x, r) for r, w in rules)
    assert np.mean((z > 0) == (y > 0)) > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(STATISTICS)).select(compiled((rules, bias)).alias("s"))
    assert np.allclose([r.s for r in df.collect()], 1 / (1 + np.exp(-z)))


def test_lasso_is_sparse():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (500, 30)).astype(float)
    y = (a[:, 0] > 0).astype(float)
    w, _ = lasso(a, y, penalty=0.02)
    assert abs(w[0]) > 1 and np.count_nonzero(w) < 15


def test_statistics_by_hand():
    texts = ["", "a a b\nC!! |", "ÀB 12"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = {k: statistics(np.frombuffer(raw, np.uint8), offsets)[:, i] for i, k in enumerate(STATISTICS)}
    assert got["n_words"].tolist() == [0, 5, 2]
    assert got["repeats_last"].tolist() == [0, 0.2, 0]
    assert got["distinct_words"].tolist() == [0, 0.8, 1]
    assert got["single_pipes"].tolist() == [0, 0.2, 0]
    assert got["words_per_line"].tolist() == [0, 2.5, 2]
    assert math.isclose(got["digits"][2], 2 / 6)
