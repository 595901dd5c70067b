"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, hashed word ends (the last three bytes) and hashed pairs of neighbouring words (the exclusive
or of both hashes, so a word met twice in a row is one term), counted over the whole text as log(1 + relative
count) times inverse document frequency. A truncated singular value decomposition of a bounded labelled sample gives
RANK latent directions. The labelled vectors (at most 2 * PER_CLASS rows of RANK numbers) are broadcast; every
document's exact cosine with all of them is taken in blocks, and its NEAREST neighbours vote, weighted by a power of similarity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import bounded
from memloom.llm.samples import fold_of, labelled
from memloom.llm.textnum import Hasher, blocks, spans

FOLDS, HELD = 5, 0
CUT = 0.3
PER_CLASS, MAX_CHARS = 1200, 8000
WORDS, ENDS, PAIRS = 2048, 2048, 512
TERMS = WORDS + ENDS + PAIRS
RANK, NEAREST, POWER = 16, 15, 8
PAIR_WEIGHT = 2.0
_PARTS = ((0, WORDS, 1.0), (WORDS, WORDS + ENDS, 1.0), (WORDS + ENDS, TERMS, PAIR_WEIGHT))

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13, 0]] = True


def counts(raw: list[bytes]) -> np.ndarray:
    """Term counts, one row for each text."""
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    n = len(raw)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, n) + 1)))
    out = np.zeros((n, TERMS), np.float32)
    start, end = spans(~_SPACE[data])
    if not len(start):
        return out
    hasher = Hasher(data)
    word, tail = hasher(start, end), hasher(np.maximum(end - 3, start), end)
    owner = np.searchsorted(bounds, start, side="right") - 1
    one = owner[1:] == owner[:-1]
    pair = (word[1:] ^ word[:-1])[one]
    for (a, b, _), of, hashed in zip(_PARTS, (owner, owner, owner[1:][one]), (word, tail, pair), strict=True):
        out[:, a:b] = np.bincount(of * (b - a) + (hashed % np.uint64(b - a)).astype(np.int64), minlength=n * (b - a)).reshape(n, b - a)
    return out


def weighed(c: np.ndarray) -> np.ndarray:
    """Logs of relative counts, so that a text's length does not matter; pairs weigh PAIR_WEIGHT times."""
    for a, b, weight in _PARTS:
        own = c[:, a:b]
        total = np.maximum(own.sum(axis=1, keepdims=True), 1)
        c[:, a:b] = weight * np.log1p(own * (1000 / total))
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions(x: np.ndarray, rank: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """The first right singular vectors, by subspace iteration: no matrix larger than ``x`` itself."""
    wide = min(rank + 16, *x.shape)
    q = np.random.default_rng(seed).normal(size=(x.shape[1], wide)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, values, turn = np.linalg.svd((x @ q).astype(np.float64), full_matrices=False)
    return (q @ turn[:rank][values[:rank] > 1e-6].T).astype(np.float32)


class Voter:
    """Latent directions and labelled unit vectors."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.constant: float | None = None
        y = np.array([q for _, q in rows], np.float32)
        if len(rows) == 0 or y.min() == y.max():
            self.constant = 1.0 if len(rows) == 0 else float(y[0])
            return
        x = np.empty((len(rows), TERMS), np.float32)
        for first, raw in blocks([t for t, _ in rows]):
            x[first : first + len(raw)] = weighed(counts(raw))
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        self.mean = x.mean(axis=0)
        x -= self.mean
        self.project = directions(x, min(RANK, len(x) - 1))
        self.vectors, self.labels = unit(x @ self.project), y
        # half of what would make both labels weigh alike, whatever the sample holds of each
        self.balance = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for first, raw in blocks(texts):
            if self.constant is not None:
                out[first : first + len(raw)] = self.constant
                continue
            latent = unit((unit(weighed(counts(raw)) * self.idf) - self.mean) @ self.project)
            for at in range(0, len(raw), 512):
                cos = latent[at : at + 512] @ self.vectors.T
                k = min(NEAREST, cos.shape[1])
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(np.float64) ** POWER * self.balance[near]
                out[first + at : first + at + len(weight)] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Voter:
    """From at most PER_CLASS texts per label, none over MAX_CHARS, outside the held-out fold."""
    return Voter(labelled(docs, labels, "quality", PER_CLASS, MAX_CHARS, FOLDS, HELD))


def score_column(voter: Voter, spark, text: Column) -> Column:
    """Quality between 0 and 1; null text counts as empty."""
    bounded()
    model = spark.sparkContext.broadcast(voter)

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()))

    return udf(text)


def score_of(docs: DataFrame, labels: DataFrame) -> Column:
    """The quality of ``docs``' column ``text`` by a classifier fitted on its labelled rows; null text counts as empty."""
    return score_column(fit(docs, labels), docs.sparkSession, F.col("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, its text read whole.

    Null and empty texts get the vote of the neighbours of a text without terms. A null id
    counts as not held out. Without labels every score is 1; with one label alone, that label.
    Repeated rows come back repeated.
    """
    out = docs.select("doc_id", score_of(docs, labels).alias("score"))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` of good quality; columns as in ``docs``, whatever their names.

    Null and empty texts get the vote of the neighbours of a text without terms, long ones are read whole, repeated rows
    stay or go together, and null ids and sources decide nothing. Without labels every row stays; an empty table gives an empty one.
    """
    return docs.filter(score_of(docs, labels) >= CUT)
