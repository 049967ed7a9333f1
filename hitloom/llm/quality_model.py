"""Quality classifier: naive Bayes support vectors.

Features are presence indicators of n-grams, of characters and of word shapes (an upper-case run, a lower-case
run, a digit run, other characters as they are, and whether the word repeats the one before), hashed to bins.
They are scaled by the log-count ratio of the two classes; a linear hinge-loss model is fitted on them by dual
coordinate descent, and a sigmoid, fitted on a fifth of the sample that the model didn't see, gives scores 0 to 1.

The model is fitted on a bounded sample: at most `sample` labelled rows (the least hashes of their ids) with at most MOST_BINS
present bins together, of those whose crc32 modulo 5 isn't 0. Scoring reads every whole text. A text without characters scores as the sigmoid of
the model's bias; so does every text if there is no labelled row of each class (score 0.5 then). Repeated rows score
alike. Null labels are left out; of repeated labels of one id the largest counts. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, code_points, map_rows, ngram_bins, table, training_row, within_bins

CHAR_BITS, SHAPE_BITS = 17, 15
BINS = (1 << CHAR_BITS) + (1 << SHAPE_BITS)
CHAR_LENGTHS, SHAPE_LENGTHS = (1, 2, 3), (1, 2, 3, 4)
SAMPLE, MOST_BINS = 4000, 1 << 25
THRESHOLD = 0.3
_RUNS = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "U"), (re.compile("[a-zß-öø-ÿ]+"), "l"), (re.compile("[0-9]+"), "d"), (re.compile(r"(.)\1+"), r"\1")]


def shape(word: str) -> int:
    body = word
    for pattern, to in _RUNS:
        body = pattern.sub(to, body)
    # The word itself counts only for telling a repeat: its hash stands above the shape's.
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) << 21) | (zlib.crc32(body.encode("utf-8", "surrogatepass")) & 0xFFFFF) << 1


class Features:
    """Bins that are present in a text, as sorted distinct numbers."""

    def __init__(self):
        self.shapes, self.mark = WordCache(shape), np.zeros(BINS, dtype=bool)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int64)
        mark = self.mark
        mark[ngram_bins(code_points(text), CHAR_LENGTHS, CHAR_BITS)] = True
        words = text.split()
        if words:
            codes = np.fromiter(map(self.shapes.__getitem__, words), dtype=np.uint64, count=len(words))
            again = np.zeros(len(codes), dtype=np.uint64)
            again[1:] = (codes[1:] >> np.uint64(21)) == (codes[:-1] >> np.uint64(21))
            mark[ngram_bins((codes & np.uint64(0x1FFFFF)) | again, SHAPE_LENGTHS, SHAPE_BITS) + (1 << CHAR_BITS)] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        return found


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss over sparse rows; labels are -1 and 1."""
    rng, n = np.random.default_rng(7), len(rows)
    w, bias, alpha = np.zeros(BINS), 0.0, np.zeros(n)
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            at, v, y = rows[i], values[i], labels[i]
            slope = y * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                moved = max(moved, abs(step))
                alpha[i] = new
                w[at] += step * v
                bias += step
        if moved < 1e-3 * cost:
            break
    return w, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps with a small ridge."""
    a, b, x = 1.0, 0.0, np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        grad = x.T @ (p - labels) + 1e-2 * np.array([a, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Model:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0):
        self.weights, self.bias, self.a, self.b = np.zeros(BINS, dtype=np.float32), 0.0, 1.0, 0.0
        if len(set(labels.tolist())) < 2:
            return
        place = np.arange(len(rows)) % 5 == 0
        if len(set(labels[place].tolist())) < 2 or len(set(labels[~place].tolist())) < 2:
            place = np.zeros(len(rows), dtype=bool)
        fit = [i for i in range(len(rows)) if not place[i]]
        counts = np.ones((2, BINS))
        for i in fit:
            counts[labels[i], rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        scaled = [(ratio[r] / max(1e-9, np.sqrt((ratio[r] ** 2).sum()))).astype(np.float32) for r in (rows[i] for i in fit)]
        w, self.bias = fit_hinge([rows[i] for i in fit], scaled, labels[fit] * 2 - 1, cost)
        self.ratio, self.weights = ratio.astype(np.float32), (w * ratio).astype(np.float32)
        test = [i for i in range(len(rows)) if place[i]] or fit
        self.a, self.b = fit_sigmoid(np.array([self.margin(rows[i]) for i in test]), labels[test])

    def margin(self, row: np.ndarray) -> float:
        if not len(row) or not self.weights.any():
            return float(self.bias)
        r = self.ratio[row].astype(np.float64)
        return float(self.weights[row].astype(np.float64).sum() / max(1e-9, np.sqrt((r * r).sum())) + self.bias)

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(row) + self.b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most `sample` labelled rows. What comes to the driver is that many rows of distinct bins."""
    known = labels.where(F.col(target).isNotNull() & F.col(key).isNotNull() & training_row(key)).groupBy(F.col(key).alias("id")).agg(F.max(target).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows

    def factory():
        bins = Features()
        return lambda texts: [[bins(t).astype(np.int32) for t in texts]]

    order = (F.xxhash64("id"), "id", F.xxhash64("bins"))
    found = map_rows(rows, ["text"], {"bins": "array<int>"}, factory).select("id", "label", "bins").orderBy(*order).limit(sample)
    table = within_bins(found, MOST_BINS, *order).orderBy(*order).toArrow()
    return Model([np.asarray(x.values, dtype=np.int32) for x in table.column("bins")], np.array(table.column("label").to_pylist(), dtype=np.int64).clip(0, 1))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append score, 0 to 1, of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights

    def factory():
        bins, m = Features(), sent.value
        return lambda texts: [[m.score(bins(t)) for t in texts]]

    return map_rows(docs, [text], {"score": "double"}, factory)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
