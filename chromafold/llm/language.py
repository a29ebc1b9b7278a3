"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte n-grams, lower-cased, with everything but letters taken as a space. Each is
hashed to a bucket with an embedding; the mean embedding goes through a linear softmax. Both layers are
trained by stochastic gradient descent in numpy on a bounded, stratified sample of labelled rows
(``per_language`` texts of each language at most); a temperature is then fitted on rows kept out of the
descent, so that scores are calibrated, and the score below which predictions are rejected is learnt there too.
Because both layers are linear, prediction needs one value per bucket and language, summed over the text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without labelled rows every
text is; of equally likely languages the first by name wins; very long texts are read whole; null ids are carried;
repeated rows get equal results; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.llm.arrowtext import slices, text_buffers

SIZES = (2, 3, 4)
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
UNKNOWN = "und"
LARGEST = 8.0  # of any parameter: keeps the descent from running away on very short texts


def subwords(data: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each n-gram size the bucket of the n-gram that starts at each byte (the last few wrap into spaces)."""
    folded = np.concatenate([_FOLD[data], np.full(max(SIZES), 0x20, np.uint32)])
    out = []
    for size in SIZES:
        key = folded[: len(data)].copy()
        for k in range(1, size):
            key = key << np.uint32(8) | folded[k : len(data) + k]
        key *= np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA6B) + np.uint32(2 * size)
        out.append(key >> np.uint32(32 - bits))
    return out


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8"))


class Model:
    """languages, table (bucket x language, embeddings times weights), bias, temperature and the score to reject below."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, bits: int, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.bits, self.threshold = languages, table.astype(np.float32), bias, temperature, bits, threshold

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text; an empty text gets the bias."""
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(data):
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            apart = np.full(len(data) + (max(SIZES) - 1) * len(size), 0x20, np.uint8)  # spaces after each text: none reads on into the next
            apart[np.arange(len(data)) + np.repeat((max(SIZES) - 1) * np.arange(len(size)), size)] = data
            begin = offsets[:-1] + (max(SIZES) - 1) * np.arange(len(size))
            edges = np.stack([begin[full], (begin + size)[full]], 1).ravel()
            grams = subwords(apart, self.bits)
            for c in range(len(self.languages)):
                column = np.ascontiguousarray(self.table[:, c])
                values = column[grams[0]]
                for g in grams[1:]:
                    values = values + column[g]
                sums[full, c] = np.add.reduceat(values, edges, dtype=np.float64)[::2]
        return sums / np.maximum(1, len(SIZES) * np.diff(offsets))[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, offsets) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], bits: int = 15, dim: int = 12, epochs: int = 6, rate: float = 0.5, spread: float = 30.0, batch: int = 32, seed: int = 7, lost: float = 0.01) -> Model | None:
    """Embeddings, softmax, temperature and threshold; every tenth text (by seeded order) only calibrates.

    The threshold rejects a share ``lost`` of the right predictions among those texts.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    bags = []
    for text in texts:
        grams = np.concatenate(subwords(np.frombuffer(text.encode(), np.uint8), bits))
        ids, counts = np.unique(grams, return_counts=True)
        bags.append((ids, (counts / max(1, len(grams))).astype(np.float32)))
    order = rng.permutation(len(texts))
    held, used = (order[::10], np.setdiff1d(order, order[::10])) if len(texts) >= 50 else (order, order)
    embed = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    weight = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages))

    def mean(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([bags[i][0] for i in some])
        share = np.concatenate([bags[i][1] for i in some])
        row = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
        out = np.zeros((len(some), dim), np.float32)
        np.add.at(out, row, embed[ids] * share[:, None])
        return ids, share, row, out

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(used), batch):
            some = rng.permutation(used)[:batch] if len(used) < batch else used[at : at + batch]
            ids, share, row, hidden = mean(some)
            wrong = softmax(hidden @ weight + bias)
            wrong[np.arange(len(some)), y[some]] -= 1
            back = (wrong @ weight.T).astype(np.float32)
            weight -= (step * hidden.T @ wrong).astype(np.float32)
            bias -= step * 0.1 * wrong.mean(0)
            np.add.at(embed, ids, -step * spread * back[row] * share[:, None])
            np.clip(weight, -LARGEST, LARGEST, out=weight)
            embed[ids] = np.clip(embed[ids], -LARGEST, LARGEST)
        used = rng.permutation(used)
    model = Model(languages, embed @ weight, bias, 1.0, bits)
    z = np.concatenate([model.logits(d := np.frombuffer(texts[i].encode(), np.uint8), np.array([0, len(d)])) for i in held])

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()

    model.temperature = min((2.0**k for k in np.arange(-5, 5.01, 0.25)), key=loss)
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    model.threshold = float(np.quantile(right, lost)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, text_col: str, label_col: str, per_language: int) -> tuple[list[str], list[str]]:
    """Distinct texts and labels, about ``per_language`` of each language, chosen by a hash of the text."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(text_col, label_col, F.xxhash64(F.lit("sample"), text_col).alias("pick"))
    counts = {r[0]: r[1] for r in known.select("pick", label_col).distinct().groupBy(label_col).count().collect()}
    if not counts:
        return [], []
    shares = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))))
    chance = F.pmod("pick", F.lit(1_000_003)) / 1_000_003
    chosen = known.where(chance < F.element_at(shares, F.col(label_col)))
    rows = chosen.groupBy("pick", label_col).agg(F.first(text_col).alias(text_col)).select(text_col, label_col).collect()  # copies count once
    rows = sorted((r[1], r[0]) for r in rows)
    return [t for _, t in rows], [k for k, _ in rows]


def identify(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             per_language: int = 500, reject_below: float | None = None, rejected_as: str | None = UNKNOWN, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; the model learns from the rows where ``learn`` holds.

    ``rejected`` marks scores below ``reject_below`` (by default the model's own threshold), whose lang_pred is then
    ``rejected_as``, or the unsure prediction itself if that is None.
    """
    if model is None:
        rows = docs.where(learn) if learn is not None else docs
        model = train(*sample(rows.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang")), "text", "lang", per_language))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2**bits x languages numbers
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                n = part.num_rows
                letters = np.concatenate([[0], np.cumsum(ascii_letter[data])])
                some = np.diff(letters[offsets]) > 0
                for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
                    some[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
                best, score = m.predict(data, offsets) if m is not None else (np.zeros(n, int), np.zeros(n))
                score = np.where(some, score, 0.0)
                least = m.threshold if m is not None and reject_below is None else reject_below or 0.0
                known = some & (m is not None)
                sure = known & (score >= least)
                names = [m.languages[b] if ok or k and rejected_as is None else rejected_as if k else UNKNOWN
                         for b, ok, k in zip(best.tolist(), sure.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(np.clip(score, 0, 1), pa.float64()), "rejected": pa.array(known & ~sure)})

    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
