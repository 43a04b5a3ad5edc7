"""Document quality from random-indexing word vectors and a two-layer network.

Each token has a sparse random index vector, given by a hash. A word's vector adds up the index
vectors around it in the training texts (and its own); words outside the VOCABULARY most frequent
ones of the training texts have their index vector alone. A document is the mean of its words'
vectors, with the norm of that mean and how often tokens, pairs and neighbours repeat. A network
of one hidden layer scores it, and a temperature that a part of the training rows chooses makes
its probabilities calibrated.

Only labelled rows outside the held-out fold teach anything: at most PER_CLASS of each class, of
which every CALIBRATION-th chooses the temperature. Without labels of both classes all scores
are 0.5.

Rows: a null or empty text has the zero vector. Repeated rows and ids give a row each, a null id
too. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.folds import held_out, prior_shift, training_rows
from panelyard.llm.runtime import bounded_batches

PER_CLASS, CALIBRATION = 4000, 5
DIM, NONZERO, AROUND = 64, 4, 2
VOCABULARY = 20_000
CACHED = 100_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 30, 64, 3e-3
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def index_vector(token: str) -> np.ndarray:
    """NONZERO entries of +1 or -1 at places that a hash of the token gives."""
    out = np.zeros(DIM, np.float32)
    h = xxhash.xxh3_64_intdigest(token)
    for _ in range(NONZERO):
        out[h % DIM] += 1.0 if h & DIM else -1.0
        h >>= 12
    return out


class Vectors:
    """Rows of word vectors; unknown tokens get their index vector."""

    def __init__(self, words: list[str], known: np.ndarray):
        self.size = len(words)
        self.table = np.zeros((CACHED + self.size, DIM), np.float32)
        self.table[: self.size] = known
        self.base = {w: i for i, w in enumerate(words)}
        self.row = dict(self.base)

    def rows(self, tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(self.row)
        if len(self.row) + len(new) > len(self.table):
            self.row = dict(self.base)
            new = set(tokens).difference(self.row)
        for t in new:
            n = len(self.row)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros((CACHED, DIM), np.float32)])
            self.table[n] = index_vector(t)
            self.row[t] = n
        return np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))

    def document(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        out = np.zeros(DIM + 6, np.float32)
        n = len(tokens)
        if not n:
            return out
        rows = self.rows(tokens)
        distinct, times = np.unique(rows, return_counts=True)
        mean = times.astype(np.float32) @ self.table[distinct] / n
        pairs = len(np.unique(rows[:-1] * (1 << 32) + rows[1:])) if n > 1 else 0
        triples = len(np.unique((rows[:-2] * 1000003 + rows[1:-1]) * 1000003 + rows[2:])) if n > 2 else 0
        out[:DIM] = mean
        out[DIM:] = np.linalg.norm(mean), len(distinct) / n, pairs / max(1, n - 1), triples / max(1, n - 2), (rows[1:] == rows[:-1]).mean() if n > 1 else 0.0, np.log1p(n) / 10
        return out


def word_vectors(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The VOCABULARY most frequent words of the training texts and their unit vectors. Words are
    counted first, so that vectors are summed, shuffled and fetched for those alone."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = Counter(token for text in batch.text for token in TOKEN.findall(text))
            yield pd.DataFrame({"word": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    counts = rows.select("text").mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    places = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # VOCABULARY words at most

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = places.value
        total, met = np.zeros((len(of), DIM)), np.zeros(len(of), bool)
        for batch in batches:
            texts = [TOKEN.findall(t) for t in batch.text]
            names = sorted(set().union(*texts))
            place = {w: i for i, w in enumerate(names)}
            index = np.stack([index_vector(w) for w in names]) if names else np.zeros((0, DIM), np.float32)
            sums = index * 0
            for tokens in texts:
                at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                for k in range(1, AROUND + 1):
                    np.add.at(sums, at[k:], index[at[:-k]])
                    np.add.at(sums, at[:-k], index[at[k:]])
                np.add.at(sums, at, index[at])
            known = np.array([i for i, w in enumerate(names) if w in of], np.int64)
            row = np.array([of[names[i]] for i in known], np.int64)
            total[row] += sums[known]
            met[row] = True
        at = np.flatnonzero(met)
        yield pd.DataFrame({"at": at, "v": pd.Series(list(total[at]), dtype=object)})

    parts = rows.select("text").mapInPandas(around, "at long, v array<double>")
    found = parts.groupBy("at").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM))).toPandas()  # VOCABULARY rows at most
    v = np.zeros((len(words), DIM), np.float32)
    v[found["at"].to_numpy(np.int64)] = found[[f"v{i}" for i in range(DIM)]].to_numpy(np.float32)
    # as long as an index vector, so that rare and frequent words weigh alike
    return words, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * np.float32(NONZERO**0.5)


class Network:
    """Two layers: tanh, then one logit; inputs are standardized by the training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        fold = np.arange(len(x)) % CALIBRATION == 0
        order = rng.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        first, second = [p * 0 for p in self.w], [p * 0 for p in self.w]
        fit, told, step = x[~fold], y[~fold], 0
        for _ in range(EPOCHS):
            mixed = rng.permutation(len(fit))
            for i in range(0, len(fit), BATCH):
                step += 1
                for p, g, m, v in zip(self.w, self.gradient(fit[mixed[i : i + BATCH]], told[mixed[i : i + BATCH]]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if fold.any():
            logit = self.logits(x[fold])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
            loss = [np.logaddexp(0, -(2 * y[fold] - 1) * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w[2] + self.w[3][0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = self.hidden(x)
        off = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]))) - y) / len(x)
        back = off[:, None] * self.w[2] * (1 - h * h)
        decay = 1e-4
        return [((x - self.mean) / self.scale).T @ back + decay * self.w[0], back.sum(0), h.T @ off + decay * self.w[2], np.array([off.sum()])]

    def probability(self, x: np.ndarray, shift: float = 0.0) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature + shift, -40, 40)))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= threshold)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = training_rows(docs, labels, "quality", PER_CLASS).persist()
    words, known = word_vectors(rows)
    table = spark.sparkContext.broadcast((words, known))  # VOCABULARY * DIM numbers at most

    @F.pandas_udf("array<float>")
    def pooled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors(*table.value)
        for texts in parts:
            yield pd.Series([vectors.document(t) for t in texts], dtype=object)

    taught = rows.select("doc_id", "y", pooled("text").alias("x")).toPandas().sort_values("doc_id")  # at most 2 * PER_CLASS rows
    rows.unpersist()
    network = Network(np.stack(taught.x.tolist()), taught.y.to_numpy()) if taught.y.nunique() == 2 else None
    shift = prior_shift(labels, "quality", PER_CLASS)

    @F.pandas_udf("double")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors(*table.value)
        for texts in parts:
            if network is None or not len(texts):
                yield pd.Series([0.5] * len(texts), dtype=float)
            else:
                yield pd.Series(network.probability(np.stack([vectors.document(t) for t in texts]), shift))

    out = docs.select("doc_id", held_out().alias("held_out"), judged(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
