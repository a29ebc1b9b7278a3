"""A quality classifier as a sparse rule ensemble.

Statistics of a text (shares of character and word kinds, repetition, line shape) feed small boosted trees,
grown in numpy on at most ``max_rows`` labelled rows. Every path of every tree is a conjunctive rule over the
statistics; a lasso logistic regression weighs the rules and drops most; the rest compile into one Spark
column expression.

Defined cases: null text counts as empty (all statistics 0) and is scored like any other; label rows without
a document, or with a null label, are not used; without labelled rows every score is 0.5; null ids are
carried; repeated rows get equal scores; very long texts are read whole; of equally good splits the first
statistic and threshold are taken; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.llm.arrowtext import gram_hashes, slices, text_buffers, word_hashes, words
from chromafold.llm.lineage import hold

STATISTICS = ("n_words", "mean_word", "distinct_words", "repeats_last", "distinct_trigrams", "upper", "digits", "symbols", "pipes",
              "marks", "non_ascii", "capital_words", "symbol_words", "single_pipes", "words_per_line", "long_words", "stops")


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("abcdefghijklmnopqrstuvwxyz"), _kind("0123456789")
_SYMBOL, _MARK = _kind("#*$%&<>@^~_=+\\{}[]"), _kind("!?")


def _counts(kind: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(kind, dtype=np.int32)])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n_rows = len(offsets) - 1
    s, e, first = words(data, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    n = np.diff(first).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    per_word = np.maximum(n, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.diff(_counts(kind)[offsets]) / size

    def among(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=flag, minlength=n_rows) / per_word

    h = word_hashes(data, s, e)
    same_row = row[1:] == row[:-1]
    last = np.concatenate([[False], (h[1:] == h[:-1]) & same_row]) if len(h) else np.zeros(0, bool)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, of))
        new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])]) if len(of) else np.zeros(0, bool)
        return np.bincount(of[order], weights=new, minlength=n_rows) / np.maximum(np.bincount(of, minlength=n_rows), 1)

    grams = gram_hashes(h, 3)
    inside = row[: len(grams)] == row[2:] if len(grams) else np.zeros(0, bool)
    upper, lower = _counts(_UPPER[data]), _counts(_LOWER[data])
    capitals = (upper[e] - upper[s] >= 2) & (lower[e] == lower[s])
    length = (e - s).astype(float)
    end = data[np.maximum(e - 1, 0)] if len(e) else data[:0]
    pipe = data == ord("|")
    lines = np.diff(_counts(data == 10)[offsets]) + 1.0
    out = {
        "n_words": n, "mean_word": np.bincount(row, weights=length, minlength=n_rows) / per_word, "distinct_words": distinct(h, row),
        "repeats_last": among(last), "distinct_trigrams": distinct(grams[inside], row[: len(grams)][inside]), "upper": share(_UPPER[data]),
        "digits": share(_DIGIT[data]), "symbols": share(_SYMBOL[data]), "pipes": share(pipe), "marks": share(_MARK[data]),
        "non_ascii": share(data >= 0x80), "capital_words": among(capitals), "symbol_words": among((_SYMBOL | _MARK)[end]),
        "single_pipes": among((length == 1) & (pipe[s] if len(s) else np.zeros(0, bool))), "words_per_line": n / lines,
        "long_words": among(length > 14), "stops": among(length <= 3),
    }
    return np.column_stack([out[k] for k in STATISTICS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the STATISTICS of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = statistics(*text_buffers(part.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(values[:, i]) for i, k in enumerate(STATISTICS)})

    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{k} double" for k in STATISTICS))


#: A rule: (statistic, is it above?, threshold) conditions that must all hold.
Rule = tuple[tuple[int, bool, float], ...]


def _split(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[float, int, float] | None:
    """The statistic and threshold that reduce the squared residual most."""
    best = None
    total, n = residual.sum(), len(residual)
    for j, at in enumerate(cuts):
        if not len(at):
            continue
        place = np.searchsorted(at, x[:, j], side="left")  # value <= at[k] for place <= k
        sums = np.cumsum(np.bincount(place, weights=residual, minlength=len(at) + 1))[:-1]
        counts = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
        ok = (counts >= least) & (n - counts >= least)
        if not ok.any():
            continue
        gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1), -np.inf)
        k = int(gain.argmax())
        if best is None or gain[k] > best[0]:
            best = float(gain[k]), j, float(at[k])
    return best if best is not None and best[0] > total**2 / n + 1e-9 else None


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, seed: int = 11) -> list[Rule]:
    """The paths of boosted trees fitted to logistic residuals, in order of discovery, each once."""
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0.005, 0.995, 64)))
        cuts.append(np.unique(np.concatenate([(values[1:] + values[:-1]) / 2, values[:1]])))
    score = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        residual = y - p
        some = rng.random(len(y)) < 0.7

        def node(rows: np.ndarray, path: Rule, level: int) -> None:
            used = rows[some[rows]]
            found = _split(x[used], residual[used], cuts, least) if level < depth and len(used) >= 2 * least else None
            if path:
                rules.setdefault(tuple(sorted(path)))
            if found is None:
                weight = np.maximum((p[rows] * (1 - p[rows])).sum(), 1e-3)
                score[rows] += rate * np.clip(residual[rows].sum() / weight, -4, 4)
                return
            _, j, at = found
            low = x[rows, j] <= at
            node(rows[low], (*path, (j, False, at)), level + 1)
            node(rows[~low], (*path, (j, True, at)), level + 1)

        node(np.arange(len(y)), (), 0)
    return list(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(and_, ((x[:, j] > at) == above for j, above, at in rule))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = a.shape
    step = 4.0 / max(1e-9, (np.square(a).sum(1).max() + 1))
    w = np.zeros(k + 1)
    z, t = w.copy(), 1.0
    full = np.column_stack([a, np.ones(n)])
    step = max(step, 4.0 * n / (np.linalg.norm(full, 2) ** 2))
    for _ in range(rounds):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ z, -50, 50))) - y) / n
        new = z - step * grad
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:k], float(w[k])


def fit(x: np.ndarray, y: np.ndarray, max_rules: int = 200) -> tuple[list[tuple[Rule, float]], float]:
    """The weighted rules and the intercept."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], math.log(share / (1 - share))
    rules = grow(x, y)
    matrix = np.column_stack([holds(x, r) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    _, keep = np.unique(matrix, axis=1, return_index=True) if rules else (None, np.zeros(0, int))
    keep = np.sort(keep)[:max_rules]
    weights, bias = lasso(matrix[:, keep], y)
    return [(rules[i], float(w)) for i, w in zip(keep, weights, strict=True) if abs(w) > 1e-6], bias


def compiled(model: tuple[list[tuple[Rule, float]], float]) -> Column:
    """The model as a column expression over the STATISTICS columns."""
    rules, bias = model
    z = F.lit(bias)
    for rule, w in rules:
        tests = [F.col(STATISTICS[j]) > at if above else F.col(STATISTICS[j]) <= at for j, above, at in rule]
        z = z + F.when(reduce(and_, tests), F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             max_rows: int = 8000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; ``learn`` says which label rows may be used.

    ``max_rows`` bounds (in expectation) the labelled rows that reach the driver, chosen by a hash of their id.
    """
    stats = hold(document_statistics(docs, id_col, text_col))
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = (usable.where(learn) if learn is not None else usable).select(F.col(id_col).alias("labelled"), F.col(label_col).cast("double").alias("y"))
    usable = usable.groupBy("labelled").agg(F.max("y").alias("y"))
    n = usable.count()
    chance = F.pmod(F.xxhash64(F.lit("sample"), "labelled"), F.lit(1_000_003)) / 1_000_003
    some = usable.where(chance < max_rows / max(n, 1))
    rows = stats.join(F.broadcast(some), stats.doc_id == some.labelled).groupBy("labelled").agg(F.max("y").alias("y"), *(F.max(k).alias(k) for k in STATISTICS)).collect()
    rows = sorted(rows, key=lambda r: str(r["labelled"]))
    x = np.array([[r[k] for k in STATISTICS] for r in rows]).reshape(len(rows), len(STATISTICS))
    model = fit(x, np.array([r["y"] for r in rows]))
    scored = stats.select("doc_id", compiled(model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
