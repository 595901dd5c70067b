"""Approximate nearest neighbours by learned partitions.

A bounded sample's nearest-neighbour graph is cut into balanced parts (spectral bisection at the median, then
swaps that save edges), more the larger the table; a small classifier learns to tell a vector's part. Every
vector goes to its most probable part, a query to its most probable parts, which are reranked by exact inner
products in double precision. How many parts a query visits is set by brute force: the fewest that
reach RECALL of the true neighbours, in the whole table, of TESTED vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.scratch import Scratch
from memloom.llm.vectors import Best, by_length, capped, index, matrix, prepare, ranked, representatives, sample, through

SAMPLE, NEIGHBOURS, EPOCHS = 6144, 12, 30
#: Parts grow with the table, from at least ROWS_A_PART rows each, up to MOST_PARTS (the sample has six vectors for each then).
ROWS_A_PART, MOST_PARTS = 32, 1024
RECALL, TESTED = 0.92, 256
SCHEMA = "query_id long, rank int, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges both ways, each once: the k largest inner products of each row."""
    n, k = len(x), min(k, len(x) - 1)
    near = []
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        near.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    a, b = np.repeat(np.arange(n), k), np.concatenate(near).ravel()
    code = np.unique(np.concatenate((a * n + b, b * n + a)))
    return code // n, code % n


def bisect(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of a graph of n nodes: the second eigenvector by power iteration, the median, then swaps."""
    d = np.sqrt(np.maximum(np.bincount(a, minlength=n), 1))
    first = d / np.linalg.norm(d)
    v = rng.normal(size=n)
    for _ in range(60):
        v = 0.5 * v + 0.5 * np.bincount(a, (v / d)[b], minlength=n) / d
        v -= first * (first @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v / d, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        across = np.bincount(a, np.where(side, 1.0, -1.0)[b], minlength=n)
        gain = np.where(side, -across, across)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        better = (gain[left[:m]] > 0) & (gain[right[:m]] > 0)
        if not better.any():
            break
        side[left[:m][better]], side[right[:m][better]] = True, False
    return side


def partition(a: np.ndarray, b: np.ndarray, n: int, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each node; parts differ by at most one node a level."""
    rng, out, step = np.random.default_rng(seed), np.zeros(n, np.int64), parts
    while step > 1:
        step //= 2
        inside = out[a] == out[b]
        a, b = a[inside], b[inside]
        place = np.zeros(n, np.int64)
        groups = np.argsort(out, kind="stable")
        edges = np.argsort(out[a], kind="stable")
        cuts, ends = np.flatnonzero(np.diff(out[groups], prepend=-1)), np.searchsorted(out[a][edges], np.unique(out))
        for own, held in zip(np.split(groups, cuts[1:]), np.split(edges, ends[1:]), strict=True):
            if len(own) > 1:
                place[own] = np.arange(len(own))
                out[own[bisect(place[a[held]], place[b[held]], len(own), rng)]] += step
    return out


class Router:
    """A softmax classifier of a vector's part, trained by Adam on part shares among neighbours."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = float(1 / max(np.sqrt((x**2).mean()), 1e-12))
        x = (x * self.scale).astype(np.float32)
        dim, parts = x.shape[1], y.shape[1]
        p = [np.zeros((dim, parts), np.float32), np.zeros(parts, np.float32)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                z = x[at] @ p[0] + p[1]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                g = (e / e.sum(axis=1, keepdims=True) - y[at]) / len(at)
                for i, grad in enumerate((x[at].T @ g + 1e-4 * p[0], g.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.99 * v[i] + 0.01 * grad**2
                    p[i] -= np.float32(0.02) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.bias = p[0].astype(np.float64), p[1].astype(np.float64)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from the most to the least probable."""
        return np.argsort(-(x * self.scale @ self.weights + self.bias), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int) -> Router:
    """The router of a sample's vectors."""
    n = len(x)
    if n < 2 or parts < 2:
        return Router(x, np.ones((n, 1), np.float32))
    a, b = neighbour_graph(x, NEIGHBOURS)
    own = partition(a, b, n, parts)
    y = np.zeros((n, parts), np.float32)
    np.add.at(y, (a, own[b]), 1)
    y /= np.maximum(y.sum(axis=1, keepdims=True), 1)
    y[np.arange(n), own] += 1
    return Router(x, y / 2)


def parts_for(total: int) -> int:
    parts = 1
    while parts * 2 <= min(MOST_PARTS, total // ROWS_A_PART):
        parts *= 2
    return parts


def bits(chosen: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(chosen, axis=1)]


def rerank(part: int, block: bytes, queries: dict, best: Best) -> None:
    """Exact inner products of a block with the queries sent to its part."""
    asked = np.flatnonzero(queries["route"][:, part >> 3] >> (7 - (part & 7)) & 1)
    if not len(asked):
        return
    dim = queries["v"].shape[1]
    n = len(block) // (8 * (dim + 2))
    rows, ids = np.frombuffer(block, np.int64, n), np.frombuffer(block, np.int64, n, 8 * n)
    c = np.frombuffer(block, np.float64, n * dim, 16 * n).reshape(n, dim)
    step = max(1, (1 << 21) // n)
    for at in range(0, len(asked), step):
        q = asked[at : at + step]
        rough = queries["v"][q] @ c.T
        cut = best.floor[q]
        if n > best.k:
            cut = np.maximum(cut, np.partition(rough, n - best.k, axis=1)[:, n - best.k])
        low = np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), -np.inf)
        i, j = np.nonzero(rough >= low[:, None])
        for at_ in range(0, len(i), 32768):
            a, b = q[i[at_ : at_ + 32768]], j[at_ : at_ + 32768]
            exact = np.cumsum(c[b] * queries["v"][a], axis=1)[:, -1]  # one order of additions for every row
            best.add(a, ids[b], rows[b], exact, part)


def packed(rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> bytes:
    return rows.tobytes() + ids.tobytes() + np.ascontiguousarray(v).tobytes()


def visits_for(way: np.ndarray, found: pd.DataFrame, k: int) -> int:
    """The fewest parts that hold RECALL of the test queries' ``k`` true neighbours."""
    place = np.empty_like(way)
    np.put_along_axis(place, way, np.arange(way.shape[1])[None].repeat(len(way), 0), axis=1)
    found = found.sort_values(["rep", "score", "vec_id"], ascending=[True, False, True])
    found = found[found["rep"] != found["row"]]
    true = found[found.groupby("rep").cumcount() < k]
    reached = place[true["at"].to_numpy(), true["part"].to_numpy()]
    return next((n for n in range(1, way.shape[1]) if (reached < n).mean() >= RECALL), way.shape[1]) if len(true) else way.shape[1]


def search(embeddings: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", said: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` selects (by ``vec_id``), its ``k`` nearest found.

    Nearness is the inner product of the vectors as doubles; ties go to the smaller id. Rows that share an id
    stay rows of their own. Which rows take part: see ``prepare`` (null, empty, zero vectors, null or
    non-finite components do not). Vectors meet those of their own length. An empty table, or one row, gives an
    empty result. A query visits further parts until these hold ``2 * (k + 1)`` rows. ``said`` is told parts,
    visits and the share of candidates scored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(prepare(embeddings, id_col, vec_col, lambda x: x, zeros=False))

    def one(mine: DataFrame) -> DataFrame | None:
        cands = scratch.save(capped(mine, k + 1).drop("h", "g"))
        total = cands.count()
        x = sample(cands, total, SAMPLE)
        if not len(x):
            x = np.array([r["v"] for r in cands.limit(1).collect()])
        parts = parts_for(total)
        router = fit(x, parts)
        model = spark.sparkContext.broadcast(router)

        @F.pandas_udf("int")
        def home(v: pd.Series) -> pd.Series:
            return pd.Series(model.value.order(matrix(v))[:, 0].astype(np.int32))

        blocks, sizes = index(cands.withColumn("part", home(F.col("v"))), packed, scratch)
        held = np.array([sizes.get(p, 0) for p in range(parts)])
        size = 8 * x.shape[1] + parts // 8 + 64
        visits = parts
        if parts > 1:
            share = F.pmod(F.xxhash64("vec_id", F.lit(29)), F.lit(1 << 52)) / F.lit(float(1 << 52))
            tested = cands.filter(share < F.lit(TESTED / total)).select(F.col("row").alias("rep"), "v").toPandas()
            if len(tested):
                every = bits(np.ones((1, parts), bool))[0]
                asked = scratch.save(spark.createDataFrame([(int(r), [float(a) for a in v], float("-inf"), every) for r, v in zip(tested["rep"], tested["v"], strict=True)], "rep long, v array<double>, floor double, route binary"))
                found = through(blocks, asked, size, k + 1, rerank, "double", scratch).toPandas()
                found["at"] = found["rep"].map({r: i for i, r in enumerate(tested["rep"])})
                visits = visits_for(router.order(matrix(tested["v"])), found, k)

        @F.pandas_udf("binary")
        def routed(v: pd.Series) -> pd.Series:
            way = model.value.order(matrix(v))
            chosen = np.zeros(way.shape, bool)
            enough = np.cumsum(held[way], axis=1) - held[way] < 2 * (k + 1)
            np.put_along_axis(chosen, way, enough | (np.arange(way.shape[1])[None] < visits), axis=1)
            return pd.Series(bits(chosen), dtype=object)

        reps, who = representatives(mine.filter(queries))
        asked = scratch.save(reps.select("rep", "v", F.lit(float("-inf")).alias("floor"), routed(F.col("v")).alias("route")))
        if said is not None:
            ways = np.array([np.unpackbits(np.frombuffer(r["route"], np.uint8))[:parts] for r in asked.select("route").collect()], bool).reshape(-1, parts)
            said.update(parts=parts, visits=visits, rows=total, scored=float((ways @ held).mean() / total) if len(ways) else 0.0)
        if asked.isEmpty():
            return None
        return ranked(through(blocks, asked, size, k + 1, rerank, "double", scratch), who, k)

    return by_length(rows, one, SCHEMA)
