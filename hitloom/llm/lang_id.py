"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the distinct n-grams (1 to 3 characters, lower-cased, hashed to
2^BITS bins) that both hold, over the root of the product of their own counts, among the n-grams that occur
in a landmark. Nystrom landmarks give explicit features; kernel ridge regression, one language against
the rest, is fitted on them in closed form. Since features and regression are linear in a text's presence vector, both fold
into one matrix (n-gram by language), and batches of texts are scored by one matrix product each.

Landmarks and training rows are a bounded sample: about `each` documents a language, at most `most` in all with at most
MOST_BINS distinct n-grams together, of rows with a language whose crc32 modulo 5 isn't 0, chosen by hash. Where `most` cuts, it cuts all languages to about the same
number of documents, and smaller ones stay whole.

`und` with score 0: null text, or a text without a letter; and every text if nothing was learned. Repeated rows
are predicted alike; ties go to the language that sorts first. Texts are read whole. All other columns pass through; one with a name of the result's is
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, map_rows, ngram_bins, table, training_row, within_bins

BITS, LENGTHS = 20, (1, 2, 3)
EACH, MOST, LANDMARKS, MOST_BINS = 300, 3000, 256, 1 << 25
#: Columns and rows of a presence matrix that stand in memory at once.
WIDE, TALL = 1 << 15, 512
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def bins_of(text: str | None) -> np.ndarray:
    """All bins of a text, with repeats."""
    return ngram_bins(code_points((text or "").lower()), LENGTHS, BITS)


def shared(rows: list[np.ndarray], marks: list[np.ndarray], size: int) -> np.ndarray:
    """How many places each row shares with each landmark (sorted places below `size`), block by block."""
    out = np.zeros((len(rows), len(marks)))

    def block(some: list[np.ndarray], low: int, high: int) -> np.ndarray:
        held = np.zeros((len(some), high - low), dtype=np.float32)
        for i, p in enumerate(some):
            held[i, p[np.searchsorted(p, low) : np.searchsorted(p, high)] - low] = 1
        return held

    for low in range(0, size, WIDE):
        high = min(size, low + WIDE)
        right = block(marks, low, high).T
        for i in range(0, len(rows), TALL):
            out[i : i + TALL] += block(rows[i : i + TALL], low, high) @ right
    return out


class Model:
    def __init__(self, rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2):
        """rows: distinct bins of each training text."""
        self.langs = sorted(set(langs))
        self.place = np.full(1 << BITS, -1, dtype=np.int32)
        self.matrix = np.zeros((0, len(self.langs)), dtype=np.float32)
        if not rows:
            return
        # Landmarks take turns over the languages.
        turn, seen = [], dict.fromkeys(self.langs, 0)
        for i, lang in enumerate(langs):
            turn.append((seen[lang], i))
            seen[lang] += 1
        marks = [i for _, i in sorted(turn)[:landmarks]]
        words = np.unique(np.concatenate([rows[i] for i in marks]))
        self.place[words] = np.arange(len(words))
        at = [np.sort(p[p >= 0]) for p in (self.place[r] for r in rows)]
        held = [at[i] for i in marks]
        own = np.sqrt(np.maximum([len(p) for p in at], 1))
        common = shared(at, held, len(words)) / (own[:, None] * own[marks][None, :])
        value, vector = np.linalg.eigh(common[marks])
        good = value > 1e-8 * value.max()
        root = vector[:, good] / np.sqrt(value[good])  # K_mm^(-1/2)
        goals = np.array([[1.0 if lang == k else -1.0 for k in self.langs] for lang in langs])
        features = np.hstack([common @ root, np.ones((len(rows), 1))])
        solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ goals)
        weight = root @ solved[:-1]  # landmark by language
        self.matrix, self.bias = np.zeros((len(words), len(self.langs)), dtype=np.float32), solved[-1].astype(np.float32)
        for places, row, size in zip(held, weight, own[marks]):
            self.matrix[places] += (row / size).astype(np.float32)

    def presence(self, bins: np.ndarray, size: int | None = None) -> np.ndarray:
        out = np.zeros((len(self.matrix) if size is None else size) + 1, dtype=np.float32)
        out[self.place[bins]] = 1  # what no landmark holds goes to the last place
        return out[:-1]

    @staticmethod
    def unit(row: np.ndarray) -> np.ndarray:
        return row / np.sqrt(max(row.sum(), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if len(self.matrix) else []
        if known:
            batch = np.stack([self.unit(self.presence(bins_of(texts[i]))) for i in known])
            values = batch @ self.matrix + self.bias
            for i, best, v in zip(known, values.argmax(1), values.max(1)):
                names[i], scores[i] = self.langs[best], float(min(1.0, max(0.0, (v + 1) / 2)))
        return names, scores


def train(docs: DataFrame, each: int = EACH, most: int = MOST, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & training_row(key))
    rows = known.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most)
    point = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) + F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 20) / float(1 << 44)
    point = point / (1 << 20)  # of all 64 bits, so that large languages have no ties
    chosen = rows.join(F.broadcast(share), "lang").where(point < each / F.col("n"))  # a row for each language, at most `most`

    def factory():
        return lambda texts: [[np.unique(bins_of(t)).astype(np.int32) for t in texts]]

    found = map_rows(chosen.select("id", "lang", "text", (point * F.col("n")).alias("nth")), ["text"], {"bins": "array<int>"}, factory)
    order = ("nth", "id", F.xxhash64("bins"))
    table = within_bins(found.select("id", "lang", "nth", "bins").orderBy(*order).limit(most), MOST_BINS, *order).orderBy(*order).toArrow()
    return Model([np.asarray(x.values, dtype=np.int32) for x in table.column("bins")], table.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred and score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks

    def factory():
        m = sent.value

        def work(texts):
            parts = [m.predict(texts[i : i + 32]) for i in range(0, len(texts), 32)]
            return [[x for p in parts for x in p[0]], [x for p in parts for x in p[1]]]

        return work

    return map_rows(docs, [text], {"lang_pred": "string", "score": "double"}, factory)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (~training_row()).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
