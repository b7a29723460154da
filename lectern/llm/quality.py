"""Document quality from random-indexing word vectors and a small network.

Words of a bounded labelled sample get context vectors: sums of the sparse ternary index vectors of their
neighbours. A document is the weighted mean of its words' vectors; a network of two layers scores it, and a
temperature fitted on held-back documents calibrates the probability.
"""

from __future__ import annotations

import math
import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

DOCS_PER_LABEL = 2500  # the bound of the sample: so many documents of each label
CHARS = 16_000_000  # and no further document of a label once those before hold so many characters
WORDS = 40_000  # of the sample, the most frequent that get a vector of their own
SIZE, NONZERO, WINDOW = 96, 6, 2
NEAR = 4  # repetitions are counted up to this distance
FEATURES = SIZE + 3 + NEAR
HIDDEN, EPOCHS, RATE = 32, 300, 0.02
CALIBRATION = 5  # each fifth document calibrates
ROWS = 500  # texts that are held at once
ACCEPT = 0.7  # the least score that predicts 1
REJECT = 0.3  # a filter drops documents below this score only

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
SHAPES = ("", "lower", "title", "upper", "mixed", "digits", "marks")


def _shape(word: str) -> int:
    """Words without a vector share one by their shape and length."""
    if word.isdigit():
        k = 5
    elif not word[0].isalpha():
        k = 6
    elif word.islower():
        k = 1
    elif word.isupper():
        k = 3 if len(word) > 1 else 2
    else:
        k = 2 if word.istitle() else 4
    return k * 4 + min(3, len(word) // 4)


UNKNOWN = len(SHAPES) * 4


def _index(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' own sparse ternary vectors, from their hashes alone: places and signs of the entries."""
    x = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(1)) % np.uint64(SIZE)).astype(np.int64), (x & np.uint64(1)).astype(float) * 2 - 1


class Model:
    """Vocabulary, word vectors, weights and network; a few ten MB at most, bounded by the parameters above."""

    def __init__(self, texts: list[str], labels: list[int]):
        counts: dict[str, int] = {}
        for x in texts:
            for w in TOKEN.findall(x):
                counts[w] = counts.get(w, 0) + 1
        kept = sorted((w for w, c in counts.items() if c > 1), key=lambda w: (-counts[w], w))[:WORDS]
        self.ids = {w: UNKNOWN + i for i, w in enumerate(kept)}
        self.seen: dict[str, int] = {}
        n = UNKNOWN + len(kept)
        places, signs = _index([f"\0{k}" for k in range(UNKNOWN)] + kept)
        docs = [self.words(TOKEN.findall(x)) for x in texts]  # texts are split anew rather than held as words
        vectors = np.zeros(n * SIZE)
        for d in range(1, WINDOW + 1):  # the context vectors: a word gathers its neighbours' index vectors
            a = np.concatenate([np.zeros(0, np.int32), *(x[:-d] for x in docs)])
            b = np.concatenate([np.zeros(0, np.int32), *(x[d:] for x in docs)])
            for own, other in ((a, b), (b, a)):
                for k in range(NONZERO):
                    for s in range(0, len(own), 1 << 20):
                        x, y = own[s : s + (1 << 20)].astype(np.int64), other[s : s + (1 << 20)]
                        vectors += np.bincount(x * SIZE + places[y, k], signs[y, k], minlength=n * SIZE)
        vectors = vectors.reshape(n, SIZE)
        for k in range(NONZERO):  # and its own
            vectors[np.arange(n), places[:, k]] += signs[:, k] * 2
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        found = np.bincount(np.concatenate([np.unique(x) for x in docs]) if docs else np.zeros(0, np.int64), minlength=n)
        self.vectors = (vectors * np.log(1 + (len(docs) + 1) / (1 + found))[:, None]).astype(np.float32)
        x = np.stack([self.pooled(d, TOKEN.findall(t)) for d, t in zip(docs, texts, strict=True)]) if docs else np.zeros((0, FEATURES), np.float32)
        self.mean, self.scale = x.mean(0) if docs else 0.0, x.std(0) + 1e-3 if docs else 1.0
        self.net, self.temperature = None, 1.0
        y = np.array(labels, float)
        if len(set(labels)) > 1:
            held = np.arange(len(y)) % CALIBRATION == 0
            self._train((x[~held] - self.mean) / self.scale, y[~held])
            self._calibrate((x[held] - self.mean) / self.scale, y[held])
        self.prior = float(y.mean()) if len(y) else 0.5

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def words(self, tokens: list[str]) -> np.ndarray:
        ids, seen = self.ids, self.seen
        out = []
        for w in tokens:
            i = ids.get(w)
            if i is None:
                i = seen.get(w)
                if i is None:
                    if len(seen) > 100_000:
                        seen.clear()
                    i = seen[w] = _shape(w)
            out.append(i)
        return np.array(out, np.int32)

    def pooled(self, ids: np.ndarray, tokens: list[str]) -> np.ndarray:
        """The mean of the words' vectors, the share of words without one, the logarithm of the length, and how many words repeat one shortly before."""
        out = np.zeros(FEATURES, np.float32)
        if len(ids):
            for s in range(0, len(ids), 16384):
                out[:SIZE] += self.vectors[ids[s : s + 16384]].sum(0)
            out[:SIZE] /= len(ids)
            out[SIZE] = (ids < UNKNOWN).mean()
            out[SIZE + 1] = math.log1p(len(ids))
            out[SIZE + 2] = len(set(tokens)) / len(tokens)
            for d in range(1, NEAR + 1):
                out[SIZE + 2 + d] = sum(map(operator.eq, tokens, tokens[d:])) / len(tokens)
        return out

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        draw = np.random.default_rng(7)
        p = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, EPOCHS + 1):
            h = np.tanh(x @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
            back = error[:, None] * p[2] * (1 - h * h)
            for k, g in enumerate((x.T @ back + 1e-3 * p[0], back.sum(0), h.T @ error + 1e-3 * p[2], error.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.net = p

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.net[0] + self.net[1]) @ self.net[2] + self.net[3][0]

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self._logits(x)
        loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - y * z / t))
        self.temperature = min((0.5, 0.7, 1, 1.4, 2, 2.8, 4, 5.6, 8), key=loss) if len(y) else 1.0

    def scores(self, texts: list) -> np.ndarray:
        """The probability of label 1 of each text; null counts as empty. Without two labels to learn from, their share."""
        if self.net is None:
            return np.full(len(texts), self.prior)
        x = np.stack([self.pooled(self.words(w), w) for w in (TOKEN.findall(t) if t else [] for t in texts)]) if texts else np.zeros((0, FEATURES))
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, where=None) -> Model:
    """Learn from at most DOCS_PER_LABEL documents of each quality. ``where`` selects rows of ``labels``.

    Labels other than 0 and 1 are left out; of several labels of one document the lowest counts, of several texts the least.
    """
    rated = labels.where(F.col("quality").isin(0, 1))
    if where is not None:
        rated = rated.where(where)
    rated = rated.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = common.bounded_sample(documents, "quality", DOCS_PER_LABEL, CHARS, rated)
    model = Model([r.text for r in rows], [r.quality for r in rows])
    del rows
    common.tidy()
    return model


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``documents`` with their score. One pass without a shuffle.

    Null and empty texts have a score as well; repeated rows are scored each by its own text. A column in ``keep`` called
    score is refused.
    """
    common.fresh(keep, ["score"])
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    at = keep.index("text") if "text" in keep else len(keep)  # a text travels once
    source = documents.select(*keep) if "text" in keep else documents.select(*keep, F.col("text").alias("_scored"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches):
        own = shipped.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                scores = own.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return source.mapInArrow(common.lean(run), f"{schema}, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned outside fold 2 of 4."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 4) != 2)
    return score(docs, model, ["doc_id"]).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
