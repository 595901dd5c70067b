"""What the vector searches share: valid rows, copies, an index of blocks, and queries sent through it.

Rows keep their own key, so repeated ids stay apart. Copies of one vector count once in the search:
candidates keep the k + 1 smallest ids of each distinct vector (more can never be among the k best of a
query other than itself), queries with one vector are searched once. Copies are told by two 64-bit hashes.

The index is a written table of blocks of about BLOCK rows, made by one shuffle. It stays where it is: batches
of queries, QUERY_BYTES at most, are broadcast, and every task runs its blocks through them, keeping the best
of each query over all its blocks, so only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.batches import bounded
from memloom.llm.scratch import Scratch

BLOCK = 4096
#: The most that one batch of queries holds; it is collected and broadcast.
QUERY_BYTES = 64 << 20
#: Pairs that wait to be ranked in a task.
PENDING = 1 << 19


def prepare(vectors: DataFrame, id_col: str, vec_col: str, transform: Callable[[Column], Column], zeros: bool) -> DataFrame:
    """``(row, vec_id, v, h, g)``: rows that take part, components as doubles after ``transform``; ``h`` and ``g`` hash the vector.

    Out are null ids; null or empty vectors, null or non-finite components, and zero vectors unless ``zeros``.
    """
    v = F.col("v")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    out = out.filter(F.col("vec_id").isNotNull() & (F.size(v) > 0))
    out = out.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zeros:
        out = out.filter(F.exists(v, lambda x: x != 0))
    out = out.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", transform).alias("v"))
    return out.select("*", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))


def by_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame | None], schema: str) -> DataFrame:
    """``search`` on the rows of each vector length: inner products join vectors of one length alone."""
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [search(rows.filter(F.size("v") == n)) for n in lengths]
    found = [f for f in found if f is not None]
    return reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], schema)


def capped(rows: DataFrame, k: int) -> DataFrame:
    """At most the ``k`` smallest ids of each distinct vector; cut within each task before the shuffle."""
    w = Window.partitionBy("h", "g").orderBy("vec_id", "row")
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def sample(rows: DataFrame, total: int, n: int) -> np.ndarray:
    """About ``n`` vectors at most, by a hash of the id, on the driver; no sort of the table."""
    if total > n:
        share = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        rows = rows.filter(share < F.lit(n / total))
    found = sorted(rows.select("vec_id", "v").collect())
    return np.array([r["v"] for r in found], np.float64)


def index(cands: DataFrame, build: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes], scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """``(part, block)`` rows of ``cands(part, row, vec_id, v)``, each built once by ``build(rows, ids, vectors)``, and the parts' sizes."""
    sizes = {r[0]: r[1] for r in cands.groupBy("part").count().collect()}  # a row for each part
    deep = {p: -(-n // BLOCK) for p, n in sizes.items() if n > BLOCK}
    split = F.lit(1)
    if deep:
        split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in deep.items() for x in pair]), F.col("part")), F.lit(1))
    keyed = cands.withColumn("b", F.pmod(F.xxhash64("row"), split).cast("int"))

    def one(key: tuple, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("row")
        return pd.DataFrame({"part": [key[0]], "block": [build(c["row"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64), matrix(c["v"]))]})

    return scratch.save(keyed.groupBy("part", "b").applyInPandas(one, "part int, block binary")), sizes


class Best:
    """The ``k`` best of each query: highest score, then smallest id, then row."""

    def __init__(self, floor: np.ndarray, k: int, whole: bool):
        self.k, self.floor, self.held, self.waiting = k, floor, [], 0
        self.kind = np.int64 if whole else np.float64

    def add(self, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, part: int) -> None:
        self.held.append((query, ids, rows, scores, np.full(len(ids), part, np.int32)))
        self.waiting += len(ids)
        if self.waiting > PENDING:
            self.rank()

    def rank(self) -> tuple[np.ndarray, ...]:
        """Keep only the best, and raise the floors; ``(query, ids, rows, scores, part)``."""
        if not self.held:
            self.held = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, self.kind, np.int32))]
        q, ids, rows, scores, part = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((rows, ids, -scores, q))
        q = q[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        order, q, last = order[place < self.k], q[place < self.k], place[place < self.k] == self.k - 1
        self.held = [(q, ids[order], rows[order], scores[order], part[order])]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[order][last])
        self.waiting = 0
        return self.held[0]


def through(blocks: DataFrame, asked: DataFrame, size: int, k: int, visit: Callable, score: str, scratch: Scratch) -> DataFrame:
    """``(rep, row, vec_id, score, part)``: the ``k`` best of each query and task.

    ``asked(rep, v, floor, route)``; ``visit(part, block, queries, best)`` adds what a block offers to ``best``, ``queries``
    being a dict of arrays. Queries go in batches of at most QUERY_BYTES, ``size`` bytes each.
    """
    bounded()
    spark = blocks.sparkSession
    total = asked.count()
    batches = max(1, -(-total * size // QUERY_BYTES))
    out = []
    for b in range(batches):
        mine = asked if batches == 1 else asked.filter(F.pmod(F.xxhash64("rep"), F.lit(batches)) == b)
        got = mine.collect()
        if not got:
            continue
        held = spark.sparkContext.broadcast(
            {"rep": np.array([r["rep"] for r in got], np.int64), "v": np.array([r["v"] for r in got], np.float64), "floor": np.array([r["floor"] for r in got], np.float64), "route": np.array([np.frombuffer(r["route"], np.uint8) for r in got])}
        )

        def run(tables: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            queries = held.value
            best = Best(queries["floor"].copy(), k, score == "long")
            for table in tables:
                for part, block in zip(table["part"], table["block"], strict=True):
                    visit(int(part), block, queries, best)
            q, ids, rows, scores, part = best.rank()
            for at in range(0, len(q), 65536):
                one = slice(at, at + 65536)
                yield pd.DataFrame({"rep": queries["rep"][q[one]], "row": rows[one], "vec_id": ids[one], "score": scores[one], "part": part[one]})

        out.append(scratch.save(blocks.mapInPandas(run, f"rep long, row long, vec_id long, score {score}, part int")))
    return reduce(DataFrame.union, out)


def representatives(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct query vectors ``(rep, v)``, and ``(query_id, query_row, rep)``."""
    reps = capped(queries, 1).select("h", "g", F.col("row").alias("rep"), "v")
    who = queries.select("h", "g", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row")).join(reps.select("h", "g", "rep"), ["h", "g"])
    return reps.select("rep", "v"), who.select("query_id", "query_row", "rep")


def ranked(found: DataFrame, who: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` of each query row without itself."""
    order = [F.desc("score"), F.col("vec_id"), F.col("row")]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).filter(F.col("n") <= k + 1)
    own = best.join(who, "rep").filter("row <> query_row")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return own.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
