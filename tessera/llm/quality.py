"""Quality classifier: a linear support vector machine over naive Bayes scaled n-gram indicators.

A text becomes a set of hashed n-grams: words, pairs of words, and sequences of one to four word
shapes (case, digits, punctuation as it stands, repetition of the word before), which carry over to
words that were never seen. Indicators are scaled by the class log-count ratio, normalised to
length one, and a hinge-loss model is fitted by dual coordinate descent. Margins become a
probability through a logistic curve fitted on held-back halves.

The fit uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id; this
is the documented bound of the sample. Scoring runs over every whole text.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept; repeated
rows are scored each; null ids are scored; without labels, or with one class only, every text gets
the smoothed share of label 1; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

#: Labelled rows that a fit uses at most.
MAX_LABELLED = 8_000
BITS = 18
MASK = (1 << BITS) - 1
#: Distinct words whose hash and shape a worker keeps.
MAX_WORDS = 100_000
THRESHOLD = 0.7

_PIECE = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+|\n")
_SEED = {k: np.uint64(v) for k, v in (("w", 0x9E3779B97F4A7C15), ("p", 0xC2B2AE3D27D4EB4F), ("s", 0x165667B19E3779F9))}


def _shape(word: str) -> str:
    if word[0].isalpha():
        return "U" if word.isupper() and len(word) > 1 else "C" if word[0].isupper() else "l"
    return "9" if word[0].isdigit() else word[:3]


class Featurizer:
    """Distinct hashed n-grams of a text, in time proportional to its length."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}
        self.last = np.zeros(1 << BITS, np.int64)

    def _codes(self, words: list[str]) -> list[tuple[int, int]]:
        known, out = self.known, []
        for w in words:
            c = known.get(w)
            if c is None:
                if len(known) >= MAX_WORDS:
                    known.clear()
                c = known[w] = (zlib.crc32(w.lower().encode()), zlib.crc32(_shape(w).encode()))
            out.append(c)
        return out

    def __call__(self, text: str) -> np.ndarray:
        words = _PIECE.findall(text)
        if not words:
            return np.zeros(0, np.int64)
        code = np.array(self._codes(words), np.uint64)
        word, shape = code[:, 0], code[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = 7  # the word before, again
        grams = [self._hash(_SEED["w"], word), self._hash(_SEED["p"], word[:-1], word[1:])]
        grams += [self._hash(_SEED["s"], *(shape[i : len(shape) - n + 1 + i] for i in range(n))) for n in range(1, 5) if len(shape) >= n]
        grams = np.concatenate(grams)
        order = np.arange(len(grams))
        self.last[grams] = order  # the last place of each n-gram stands for it
        return grams[self.last[grams] == order]

    @staticmethod
    def _hash(seed: np.uint64, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), seed, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """``weights`` already hold the log-count ratios; ``ratio`` is needed for the length of a row."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, grams: np.ndarray) -> float:
        if not len(grams):
            return self.bias
        norm = np.sqrt(np.square(self.ratio[grams], dtype=np.float64).sum())
        return float(self.weights[grams].sum(dtype=np.float64) / norm + self.bias) if norm else self.bias

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.offset, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    size = 1 << BITS
    p, q = np.full(size, smooth), np.full(size, smooth)
    for g, label in zip(rows, y):
        (p if label else q)[g] += 1
    return (np.log(p / (smooth + (y == 1).sum())) - np.log(q / (smooth + (y == 0).sum()))).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss machine, L1 loss; the bias is a feature of value 1.

    The two classes get costs in inverse proportion to their share.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    alpha, w, bias = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    square = np.array([float(np.square(v, dtype=np.float64).sum()) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _machine(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = log_count_ratio(rows, y)
    values = []
    for g in rows:
        v = ratio[g]
        n = np.sqrt(np.square(v, dtype=np.float64).sum())
        values.append((v / n).astype(np.float32) if n else v)
    w, bias = dual_coordinate_descent(rows, values, y)
    return Model(ratio, (w * ratio).astype(np.float32), bias, 1.0, 0.0)


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets drawn in from 0 and 1."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    y = np.asarray(y)
    if len(set(y.tolist())) < 2:
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    model = _machine(rows, y)
    margins = np.zeros(len(y))
    half = np.arange(len(y)) % 2
    for k in (0, 1):
        other = np.flatnonzero(half != k)
        if len(set(y[other].tolist())) < 2:
            return model
        held = _machine([rows[i] for i in other], y[other])
        for i in np.flatnonzero(half == k):
            margins[i] = held.margin(rows[i])
    model.slope, model.offset = _logistic(margins, y)
    return model


def is_held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows that aren't held out. An id with two labels has the smaller one; of rows that share
    an id, the one whose n-grams come first stands for them."""
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out("id"))
        .groupBy("id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    spark = docs.sparkSession
    picked = spark.createDataFrame([tuple(r) for r in sample.collect()], sample.schema)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for batch in batches:
            out = [f(t.as_py() or "").astype("<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(out, pa.binary())], ["id", "y", "grams"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")  # at most max_labelled ids
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    # rows that share an id give one example, the one whose n-grams come first; at most max_labelled rows come to the driver
    found = texts.mapInArrow(tidy(grams), f"id {types['id']}, y {types['y']}, grams binary").groupBy("id", "y").agg(F.min("grams").alias("grams")).toArrow()
    found = found.sort_by("id")
    rows = [np.frombuffer(g.as_buffer(), "<i4") for g in found.column("grams")]  # views of the one copy
    return fit(rows, found.column("y").to_numpy().astype(int))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB: two numbers for each n-gram bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Featurizer(), sent.value
        for batch in batches:
            out = [m.score(f(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{fields}, `{score_col}` double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
