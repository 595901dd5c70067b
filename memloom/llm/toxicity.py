"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters and digits, A-Z lower-cased) hash to an embedding row; the hashes of
their first four and six bytes add rows of their own, so that spelling variants share weight.
Filters of widths one, two and three slide over the words, a maximum over the whole text
pools each, and a logistic layer scores the pooled values. Buckets met in fewer than MIN_DOCS
training texts stay at zero. Thresholds are calibrated by language: the language is guessed from
the text's own function words, and a language's best threshold on the training texts is moved to CUT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import bounded
from memloom.llm.samples import fold_of, labelled
from memloom.llm.textnum import Hasher, blocks, spans

FOLDS, HELD = 4, 2
CUT = 0.3
PER_CLASS, MAX_CHARS = 1500, 8000
BUCKETS = (1 << 16, 1 << 14, 1 << 14)
PREFIXES = (None, 4, 6)
DIM, FILTERS, WIDTHS = 6, 6, (1, 2, 3)
MIN_DOCS = 3
#: Common function words, by language.
LANGUAGES = {
    "en": "the of and to in is that it for was are this with".split(),
    "de": "der die und das den von ist des ein eine mit".split(),
    "fr": "le la les des et un une du que est dans".split(),
    "es": "el los las de y del por con una su para".split(),
}
_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a block of texts: bucket ids per embedding table, and each text's range of words."""

    def __init__(self, raw: list[bytes]):
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        start, end = spans(_WORD[data])
        hasher = Hasher(_LOWER[data])
        self.full = hasher(start, end)
        self.ids = []
        base = 1
        for n, prefix in zip(BUCKETS, PREFIXES, strict=True):
            h = self.full if prefix is None else hasher(start, np.minimum(start + prefix, end))
            self.ids.append((h % np.uint64(n - 1)).astype(np.int32) + base)
            base += n
        edge = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
        self.first, self.last = edge[:-1], edge[1:]
        self.n = len(raw)


def language(words: Words) -> np.ndarray:
    """Index of the language whose function words a text has most of; the first without any."""
    counts = np.zeros((words.n, len(LANGUAGES)))
    for k, listed in enumerate(_LANG_HASHES):
        hits = np.concatenate(([0], np.cumsum(np.isin(words.full, listed))))
        counts[:, k] = hits[words.last] - hits[words.first]
    return counts.argmax(axis=1)


_LANG_HASHES = [Words([" ".join(v).encode()]).full for v in LANGUAGES.values()]


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((1 + sum(BUCKETS), DIM), np.float32)
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-2.0)
        self.shift = np.zeros(len(LANGUAGES), np.float32)
        self.constant: float | None = None

    def embed(self, words: Words) -> np.ndarray:
        return self.table[words.ids[0]] + self.table[words.ids[1]] + self.table[words.ids[2]]

    def respond(self, x: np.ndarray, words: Words) -> list[np.ndarray]:
        """Filter responses at each word; a text's windows see zeros beyond its end."""
        out = []
        n = len(x)
        ends = words.last[words.last > words.first]
        for k, w in enumerate(WIDTHS):
            y = x @ self.filters[k][0]
            for j in range(1, w):
                moved = x[j:] @ self.filters[k][j]
                for i in range(1, j + 1):  # the last words of a text have no word j further on
                    at = ends - i
                    moved[at[(at >= 0) & (at < n - j)]] = 0
                y[: n - j] += moved
            out.append(np.maximum(y + self.bias[k], 0))
        return out

    def pool(self, y: np.ndarray, words: Words) -> np.ndarray:
        out = np.zeros((words.n, y.shape[1]), np.float32)
        full = words.last > words.first
        if full.any():
            out[full] = np.maximum.reduceat(y, words.first[full], axis=0)
        return out

    def logits(self, words: Words) -> np.ndarray:
        x = self.embed(words)
        pooled = np.concatenate([self.pool(y, words) for y in self.respond(x, words)], axis=1)
        return pooled @ self.out + self.base

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for first, raw in blocks(texts):
            if self.constant is not None:
                out[first : first + len(raw)] = self.constant
                continue
            words = Words(raw)
            z = self.logits(words).astype(np.float64) + self.shift[language(words)]
            out[first : first + len(raw)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def log_odds(words: list[Words], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: z-score of its document odds for label one, and the number of documents."""
    ones, zeros = np.zeros(1 + sum(BUCKETS)), np.zeros(1 + sum(BUCKETS))
    at = 0
    for w in words:
        for d in range(w.n):
            own = np.unique(np.concatenate([ids[w.first[d] : w.last[d]] for ids in w.ids]))
            (ones if y[at] else zeros)[own] += 1
            at += 1
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    a, b = ones + 0.5, zeros + 0.5
    z = (np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))) / np.sqrt(1 / a + 1 / b)
    return z, ones + zeros


def train(rows: list[tuple[str, int]], epochs: int = 9, rate: float = 0.05, seed: int = 7) -> Net:
    """Adam over mini-batches of blocks; without both labels the net gives a constant score."""
    net, rng = Net(seed), np.random.default_rng(seed)
    y_all = np.array([y for _, y in rows], np.float32)
    if len(rows) == 0 or y_all.min() == y_all.max():
        net.constant = 0.0 if len(rows) == 0 else float(y_all[0])
        return net
    order = rng.permutation(len(rows))
    texts, y_all = [rows[i][0] for i in order], y_all[order]
    parts = [(first, Words(raw)) for first, raw in blocks(texts, 1 << 17)]
    z, seen = log_odds([w for _, w in parts], y_all)
    live = seen >= MIN_DOCS
    net.table = rng.normal(0, 0.05, net.table.shape).astype(np.float32)
    net.table[:, 0] += np.clip(z / 4, -1.5, 1.5)
    net.table[~live] = 0
    for k in range(len(WIDTHS)):
        net.filters[k][0, 0, :2] = 1.0
        net.bias[k][:2] = -1.0
        net.out[k * FILTERS : k * FILTERS + 2] = 1.0
    params = {"out": net.out, "base": np.array([net.base])} | {f"f{k}": f for k, f in enumerate(net.filters)} | {f"b{k}": b for k, b in enumerate(net.bias)}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v2 = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / (1 - y_all.mean())).astype(np.float32)
    step = 0
    for _ in range(epochs):
        for first, words in parts:
            step += 1
            y = y_all[first : first + words.n]
            x = net.embed(words)
            resp = net.respond(x, words)
            pooled = [net.pool(r, words) for r in resp]
            h = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + params["base"][0], -30, 30)))
            g = (p - y) * weight[first : first + words.n] / words.n
            grad = {"out": h.T @ g + 1e-4 * net.out, "base": np.array([g.sum()])}
            dx: dict[int, np.ndarray] = {}
            for k, w in enumerate(WIDTHS):
                gh = g[:, None] * net.out[k * FILTERS : (k + 1) * FILTERS][None]
                gf, gb = np.zeros_like(net.filters[k]), np.zeros(FILTERS, np.float32)
                for d in range(words.n):
                    a, b = words.first[d], words.last[d]
                    if a == b:
                        continue
                    top = a + resp[k][a:b].argmax(axis=0)
                    on = pooled[k][d] > 0
                    for f in np.flatnonzero(on):
                        gb[f] += gh[d, f]
                        for j in range(min(w, b - top[f])):
                            gf[j, :, f] += gh[d, f] * x[top[f] + j]
                            i = int(top[f] + j)
                            dx[i] = dx.get(i, 0) + gh[d, f] * net.filters[k][j, :, f]
                grad[f"f{k}"], grad[f"b{k}"] = gf + 1e-4 * net.filters[k], gb
            for name, value in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * value
                v2[name] = 0.99 * v2[name] + 0.01 * value**2
                params[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for i, value in dx.items():
                for ids in words.ids:
                    if live[ids[i]]:
                        net.table[ids[i]] -= rate * 4 * value
        net.base = np.float32(params["base"][0])
    calibrate(net, texts, y_all)
    return net


def calibrate(net: Net, texts: list[str], y: np.ndarray) -> None:
    """Move each language's best threshold on the training texts to CUT; few texts use the common one."""
    z, lang = [], []
    for _, raw in blocks(texts):
        words = Words(raw)
        z.append(net.logits(words))
        lang.append(language(words))
    z, lang = np.concatenate(z), np.concatenate(lang)
    goal = np.log(CUT / (1 - CUT))
    common = goal - best_cut(z, y)
    for k in range(len(LANGUAGES)):
        own = lang == k
        enough = own.sum() >= 40 and y[own].sum() >= 10 and (1 - y[own]).sum() >= 10
        net.shift[k] = goal - best_cut(z[own], y[own]) if enough else common


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among thresholds with the best balanced accuracy."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    below = np.concatenate(([0], np.cumsum(1 - y))) / max(1, (1 - y).sum())
    above = 1 - np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())
    good = below + above
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    gap = edge[1:] - edge[:-1]
    best = np.flatnonzero(good >= good.max() - 1e-9)
    at = best[gap[best].argmax()]
    return float((edge[at] + edge[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Train on at most PER_CLASS texts per label, none over MAX_CHARS, outside the held-out fold."""
    return train(labelled(docs, labels, "toxic", PER_CLASS, MAX_CHARS, FOLDS, HELD))


def score_column(net: Net, spark, text: Column) -> Column:
    """Toxicity between 0 and 1; null text counts as empty."""
    bounded()
    model = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()))

    return udf(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts score what no word scores. A null id counts as not held out.
    Without labels of both kinds every score is 0, or 1 if all are toxic. Repeated rows
    come back repeated.
    """
    net = fit(docs, labels)
    out = docs.select("doc_id", score_column(net, docs.sparkSession, F.col("text")).alias("score"))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic; columns as in ``docs``, whatever their names.

    Null and empty texts score what no word scores, long ones are read whole, repeated rows stay or go together, and
    null ids and sources decide nothing. Without labels every row stays; an empty table gives an empty one.
    """
    return docs.filter(score_column(fit(docs, labels), docs.sparkSession, F.col("text")) < CUT)
