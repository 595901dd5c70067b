"""Exact top-k by integer inner product: best-first search in M-trees.

With one more coordinate sqrt(M^2 - |v|^2), M the largest norm of all, the Euclidean distance of a query (with 0
there) falls as the inner product rises, so a metric tree can serve. A bounded sample gives pivots, more the larger
the table: each vector goes below its nearest one. Each block of a pivot's vectors is an M-tree of pages, built once
and written: an inner entry has a pivot, a covering radius and its distance to the parent's pivot, a leaf entry its
distance to the parent's. Queries start from the k-th best score within the sample, skip trees whose ball lies beyond
it, go through a tree by the smallest possible distance, and leave out entries the stored distances already exclude.
Scores are exact 64-bit integers; a bound excludes only what is farther than the k-th best by more than rounding can explain.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.scratch import Scratch
from memloom.llm.vectors import Best, by_length, capped, index, matrix, prepare, ranked, representatives, sample, through

SAMPLE, MOST_PARTS = 4096, 512
PAGE, FANOUT = 64, 32
#: Queries that go through a tree together.
TOGETHER = 1024
SLACK = 1e-9
SCHEMA = "query_id long, rank int, vec_id long, score long"


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0))
    return np.concatenate((v, rest[:, None]), axis=1)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def rounding(base: float | np.ndarray, dim: int) -> float | np.ndarray:
    """How far a distance computed from squares about ``base`` can be off: nothing while they are exact integers."""
    return np.where(np.asarray(base) >= 2.0**52, np.sqrt((dim + 8) * 2.0**-51 * np.asarray(base)), 0.0)


def reach(base: float | np.ndarray, low: float | np.ndarray, dim: int) -> float | np.ndarray:
    """The distance beyond which scores are below ``low``; ``base`` is the squared norms of query and top."""
    wide = 2 * rounding(base, dim)
    return np.where(np.isfinite(low), np.sqrt(np.maximum(base - 2 * np.where(np.isfinite(low), low, 0), 0)) + wide, np.inf)


class Node:
    """A page: rows of the pivots or vectors, their distances to this page's own pivot, and, if inner, radii and children."""

    __slots__ = ("children", "points", "radii", "rows", "to_parent")

    def __init__(self, rows: np.ndarray, points: np.ndarray, pivot: np.ndarray, rng: np.random.Generator):
        if len(rows) <= PAGE:
            self.rows, self.points, self.children, self.radii = rows, None, None, None
            self.to_parent = distances(points, pivot)
            return
        n = min(FANOUT, -(-len(rows) // PAGE))
        pivots = points[np.sort(rng.choice(len(rows), n, replace=False))]
        near = ((pivots**2).sum(axis=1)[None] - 2 * points @ pivots.T).argmin(axis=1)
        if np.bincount(near, minlength=n).max() == len(rows):  # no pivot parts these: even pages
            near = np.arange(len(rows)) % n
        used = [p for p in range(n) if (near == p).any()]
        self.rows, self.points = None, pivots[used]
        self.to_parent = distances(self.points, pivot)
        self.children = [Node(rows[near == p], points[near == p], pivots[p], rng) for p in used]
        self.radii = np.array([distances(points[near == p], pivots[p]).max() for p in used])


class Tree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: float, seed: int = 7):
        self.rows, self.ids, self.top = rows, ids, top
        self.whole = vectors.astype(np.int64)
        points = lifted(vectors, top)
        self.pivot = points.mean(axis=0)
        self.radius = float(distances(points, self.pivot).max())
        self.root = Node(np.arange(len(ids)), points, self.pivot, np.random.default_rng(seed))

    def best(self, query: np.ndarray, to_pivot: float, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the ``k`` best among scores of at least ``floor`` (ties included), and how many were computed."""
        _, at, scores, computed = self.all_best(query[None], np.array([to_pivot]), k, np.array([floor], np.float64))
        keep = np.lexsort((self.rows[at], self.ids[at], -scores))[:k]
        return at[keep], scores[keep], computed

    def all_best(self, queries: np.ndarray, to_pivot: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query, place and score of what may be among each query's ``k`` best of at least its ``floor`` (ties included, the best never left out), and how many scores the bounds let in."""
        n, dim = queries.shape
        base = (queries**2).sum(axis=1) + self.top
        points, off = np.concatenate((queries, np.zeros((n, 1))), axis=1), rounding(base, dim)
        exact = float(base.max()) < 2.0**52  # so every partial sum is a whole number that a double holds
        whole = queries if exact else queries.astype(np.int64)
        kth = np.full((n, k), np.iinfo(np.int64).min)  # the best scores so far, in no order
        low, found, computed, order = kth.min(axis=1), [], 0, 0

        def limits(q: np.ndarray) -> np.ndarray:
            known = np.where(low[q] > np.iinfo(np.int64).min, low[q].astype(np.float64), -np.inf)
            return reach(base[q], np.maximum(floor[q], known), dim) * (1 + SLACK)

        heap = [(0.0, order, self.root, np.arange(n), to_pivot, np.zeros(n))]
        while heap:
            _, _, node, q, near, bound = heapq.heappop(heap)
            slack = SLACK * (1 + near) + off[q]
            open_ = bound <= limits(q) + slack
            if not open_.any():
                continue
            q, near, slack = q[open_], near[open_], slack[open_]
            limit = limits(q)[:, None]
            apart = np.abs(near[:, None] - node.to_parent) - slack[:, None]
            if node.children is None:
                let_in = apart <= limit
                computed += int(let_in.sum())
                page = self.whole[node.rows]
                scores = (whole[q] @ (page.astype(np.float64) if exact else page).T).astype(np.int64)
                let_in &= (scores >= low[q][:, None]) & (scores >= floor[q][:, None])
                i, j = np.nonzero(let_in)
                if len(i):
                    found.append((q[i], node.rows[j], scores[i, j]))
                    some = np.unique(i)
                    both = np.concatenate((kth[q[some]], np.where(let_in[some], scores[some], np.iinfo(np.int64).min)), axis=1)
                    kth[q[some]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    low[q[some]] = kth[q[some]].min(axis=1)
                continue
            entries = apart - node.radii <= limit
            for c in np.flatnonzero(entries.any(axis=0)):
                mine = np.flatnonzero(entries[:, c])
                d = distances(points[q[mine]], node.points[c])
                least = d - node.radii[c]
                mine, d, least = (x[least <= limit[mine, 0] + slack[mine]] for x in (mine, d, least))
                if len(mine):
                    order += 1
                    least = np.maximum(least, 0.0)
                    heapq.heappush(heap, (float(least.min()), order, node.children[c], q[mine], d, least))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none, computed
        q, at, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = scores >= low[q]
        return q[keep], at[keep], scores[keep], computed


def visit(part: int, block: bytes, queries: dict, best: Best) -> None:
    """The best of one tree for every query its ball lets in."""
    tree = pickle.loads(block)
    v, dim = queries["v"], queries["v"].shape[1]
    apart = distances(np.concatenate((v, np.zeros((len(v), 1))), axis=1), tree.pivot)
    base = (v**2).sum(axis=1) + tree.top
    open_ = np.flatnonzero(apart - tree.radius <= reach(base, best.floor, dim) * (1 + SLACK) + SLACK * (1 + apart) + rounding(base, dim))
    for first in range(0, len(open_), TOGETHER):
        q = open_[first : first + TOGETHER]
        mine, at, scores, _ = tree.all_best(v[q], apart[q], best.k, best.floor[q])
        if len(at):
            best.add(q[mine], tree.ids[at], tree.rows[at], scores, part)
    best.rank()


def search(embeddings: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` selects (by ``vec_id``), its exact ``k`` best.

    Components become ``floor(scale * x)``; ties go to the smaller id. Rows that share an id stay rows of their own.
    Which rows take part: see ``prepare`` (zero vectors do). Vectors meet those of their own length. An empty table, or
    one row, gives an empty result. Components of 2**53 and more and scores of 2**62 and more raise a ValueError.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "mtree")
    rows = scratch.save(prepare(embeddings, id_col, vec_col, lambda x: F.floor(x * scale).cast("double"), zeros=True))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, a: acc + a * a)
    largest = rows.agg(F.max(norm), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if largest[0] is not None and (largest[0] >= 2.0**62 or largest[1] >= 2.0**53):
        raise ValueError("components or scores are too large for exact 64-bit integers")

    def one(mine: DataFrame) -> DataFrame | None:
        cands = scratch.save(capped(mine, k + 1).drop("h", "g"))
        reps, who = representatives(mine.filter(queries))
        total = cands.count()
        x = sample(cands, total, SAMPLE)
        if not len(x):
            x = np.array([r["v"] for r in cands.limit(1).collect()])
        top = cands.agg(F.max(norm)).first()[0]
        parts = max(1, min(MOST_PARTS, len(x), int(total**0.5 / 4)))
        pivots = lifted(x[np.linspace(0, len(x) - 1, parts).astype(int)], top)

        @F.pandas_udf("int")
        def placed(v: pd.Series) -> pd.Series:
            return pd.Series(((pivots**2).sum(axis=1)[None] - 2 * lifted(matrix(v), top) @ pivots.T).argmin(axis=1).astype(np.int32))

        @F.pandas_udf("double")
        def floor(v: pd.Series) -> pd.Series:
            q = matrix(v)
            if len(x) <= k:
                return pd.Series(np.full(len(q), -np.inf))
            base = (q**2).sum(axis=1) + top
            return pd.Series(np.partition(q @ x.T, len(x) - k - 1, axis=1)[:, len(x) - k - 1] - np.where(base >= 2.0**52, (x.shape[1] + 8) * 2.0**-51 * base, 0))

        def tree(at: np.ndarray, ids: np.ndarray, v: np.ndarray) -> bytes:
            return pickle.dumps(Tree(at, ids, v, top), protocol=5)

        blocks, _ = index(cands.withColumn("part", placed(F.col("v"))), tree, scratch)
        asked = scratch.save(reps.select("rep", "v", floor(F.col("v")).alias("floor"), F.lit(b"").alias("route")))
        if asked.isEmpty():
            return None
        return ranked(through(blocks, asked, 8 * x.shape[1] + 64, k + 1, visit, "long", scratch), who, k)

    return by_length(rows, one, SCHEMA)
