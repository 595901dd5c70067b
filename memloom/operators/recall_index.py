"""Recall from an index that ends early: blocks of memories that cannot reach the k-th score are not read.

A memory's score is the share of the query's distinct word runs it holds. Memories fall into blocks of about
``per_block`` by a hash of their id. ``postings/part=…`` has one row for each run of a memory, sorted by block;
``tops/`` has one row for each run and block, so the number of a query's runs that a block has at all bounds the score of
every memory in it. A query reads the blocks with the highest bounds first; the k-th score found there rules out all
blocks below it, as a block bounded by fewer hits than that score cannot change the answer. Ties are read, so the answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators.retrieve import shingled
from memloom.sources.shared import new_folder, written

#: Blocks of a query that are read before a score is known; rows that are broadcast at most.
FIRST, BROADCAST = 16, 200_000


class RecallIndex:
    """An index below ``folder`` of ``memories(memory_id, content)`` by runs of ``n`` words."""

    def __init__(self, spark: SparkSession, folder: str, n: int = 1, parts: int = 64, id_type: str = "string"):
        self.spark, self.folder, self.n, self.parts, self.id_type = spark, folder.rstrip("/"), n, parts, id_type

    def _part(self, block: Column) -> Column:
        return F.pmod(F.hash(block), F.lit(self.parts)).cast("int")

    def build(self, memories: DataFrame, per_block: int = 128) -> RecallIndex:
        """Index all memories; one that repeats counts once, null contents have no runs."""
        # written once: they are counted, sampled for the ranges, and indexed
        rows = written(memories.select("memory_id", "content"), new_folder(self.spark, "memories"))
        blocks = max(1, -(-rows.select("memory_id").distinct().count() // per_block))
        runs = shingled(rows, "memory_id", "content", self.n).withColumn("block", F.pmod(F.xxhash64("memory_id"), F.lit(blocks)))
        # one shuffle: ranges of (part, block) hold the repeats of a memory together, and a task writes few parts
        keys = ["part", "block", "memory_id", "gram"]
        placed = runs.withColumn("part", self._part(F.col("block"))).repartitionByRange(*keys).dropDuplicates(keys)
        placed.sortWithinPartitions("part", "block").write.partitionBy("part").parquet(f"{self.folder}/postings")
        self.postings().select("gram", "block").distinct().write.parquet(f"{self.folder}/tops")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"memory_id {self.id_type}, gram long, block long, part int").parquet(f"{self.folder}/postings")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """``(query_id, rank, memory_id, score)`` of ``queries(query_id, query)``: as ``retrieve.recall`` gives it."""
        return self.answered(queries, k)[0]

    def answered(self, queries: DataFrame, k: int = 5) -> tuple[DataFrame, dict[str, int]]:
        """The answer, and ``blocks``: pairs of a query and a block with any of its runs, and ``read``, those whose postings were read."""
        work = new_folder(self.spark, "recall")
        asked = written(shingled(queries, "query_id", "query", self.n).distinct(), f"{work}/asked")
        sizes = asked.groupBy("query_id").agg(F.count("*").alias("size"))
        tops = self.spark.read.schema("gram long, block long").parquet(f"{self.folder}/tops").join(asked, "gram")
        bounds = written(tops.groupBy("query_id", "block").agg(F.count("*").alias("bound")), f"{work}/bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        ranked = bounds.withColumn("place", F.row_number().over(order))
        first = written(self._hits(ranked.filter(F.col("place") <= FIRST).select("query_id", "block"), asked), f"{work}/first")
        best = Window.partitionBy("query_id").orderBy(F.desc("hits"), "memory_id")
        least = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("hits").alias("least"))
        # a block that cannot beat or tie the k-th hits so far is never read
        rest = ranked.filter(F.col("place") > FIRST).join(least, "query_id", "left").filter("bound >= coalesce(least, 0)").select("query_id", "block")
        rest = written(rest, f"{work}/rest")
        hits = first.unionByName(self._hits(rest, asked))
        scored = hits.join(sizes, "query_id").select("query_id", "memory_id", F.round(F.col("hits") / F.col("size"), 6).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
        out = scored.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "memory_id", "score")
        counts = bounds.groupBy("query_id").agg(F.least(F.count("*"), F.lit(FIRST)).alias("f"), F.count("*").alias("n")).agg(F.sum("n"), F.sum("f")).first()
        return out, {"blocks": counts[0] or 0, "read": (counts[1] or 0) + rest.count()}

    def _hits(self, chosen: DataFrame, asked: DataFrame) -> DataFrame:
        """``(query_id, memory_id, hits)`` of the memories in ``chosen(query_id, block)``."""
        wanted = chosen.withColumn("part", self._part(F.col("block"))).join(asked, "query_id")
        few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
        # broadcast, the parts of the chosen blocks are the only folders read, and other blocks' rows go where they are read
        met = self.postings().join(F.broadcast(wanted) if few else wanted, ["part", "block", "gram"])
        return met.groupBy("query_id", "memory_id").agg(F.count("*").alias("hits"))
