"""Retrieval quality: recall, precision and reciprocal rank, their means, and a gate against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import patterns

CUTOFF, DROP, ANCHOR = 5, 0.10, 4


def recall_at(relevant: Column, retrieved: Column, k: int = CUTOFF) -> Column:
    hits = F.size(F.array_intersect(relevant, F.slice(retrieved, 1, k)))
    return F.when(F.size(relevant) > 0, hits / F.size(relevant)).otherwise(F.lit(0.0))


def precision_at(relevant: Column, retrieved: Column, k: int = CUTOFF) -> Column:
    hits = F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x)))
    return F.when(F.size(retrieved) > 0, hits / F.lit(k)).otherwise(F.lit(0.0))


def reciprocal_rank(relevant: Column, retrieved: Column) -> Column:
    ranks = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(F.lit(1.0) / F.array_min(F.filter(ranks, lambda r: r.isNotNull())), F.lit(0.0))


def scored(rows: DataFrame) -> DataFrame:
    """``rows(query_id, relevant, retrieved)`` → ``(query_id, recall, precision, mrr)``."""
    a, b = F.col("relevant"), F.col("retrieved")
    return rows.select("query_id", recall_at(a, b).alias("recall"), precision_at(a, b).alias("precision"), reciprocal_rank(a, b).alias("mrr"))


def averaged(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("queries"), *[F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in ("recall", "precision", "mrr")])


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(mrr, baseline_mrr, blocking)`` of two one-row averages."""
    both = current.select("mrr").crossJoin(baseline.select(F.col("mrr").alias("baseline_mrr")))  # one row and one row
    return both.withColumn("blocking", F.col("mrr") - F.col("baseline_mrr") < -DROP)


def containing(memories: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, memory_id)``: which ``memories(memory_id, content)`` hold an item's whole text; empty items match nothing.

    Items of up to ``patterns.CHARACTERS`` characters together are one automaton, and each memory is read once. Of more
    items those of six words or more are found by a join: four neighbouring words from the item's middle, which must
    be whole words of the memory too, are looked up by hash, and the text is compared where they meet; the rest go to automata.
    """
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= patterns.CHARACTERS:
        return patterns.occurrences(memories, items)
    cut = lambda c: F.split(F.col(c), r"[ \t\n\x0B\f\r]+")
    long = F.size(cut("text")) >= ANCHOR + 2
    asked = items.filter(long).select("item_id", F.xxhash64(F.array_join(F.slice(cut("text"), 2, ANCHOR), " ")).alias("h"))
    held = memories.select("memory_id", cut("content").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (ANCHOR - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, ANCHOR), " ")))
    near = held.select("memory_id", F.explode(F.array_distinct(runs)).alias("h")).join(asked, "h").select("memory_id", "item_id").distinct()
    found = memories.select("memory_id", "content").join(near, "memory_id").join(items.select("item_id", "text"), "item_id")
    found = found.filter(F.col("content").contains(F.col("text"))).select("item_id", "memory_id")
    return found.unionByName(patterns.occurrences(memories, items.filter(~long)))


def golden(relevant: DataFrame, retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, recall, precision, mrr)`` from relevant pairs and results ranked up to CUTOFF; relevant ids are counted, never gathered."""
    n = relevant.groupBy(F.col("item_id").alias("query_id")).agg(F.count("*").alias("n"))
    got = retrieved.groupBy("query_id").agg(F.count("*").alias("got"))
    right = relevant.select(F.col("item_id").alias("query_id"), "memory_id")
    right = retrieved.join(right, ["query_id", "memory_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    out = queries.select("query_id").join(n, "query_id", "left").join(got, "query_id", "left").join(right, "query_id", "left")
    share = lambda whole: F.coalesce(F.col("hits") / whole, F.lit(0.0))
    return out.select("query_id", share(F.col("n")).alias("recall"), share(F.lit(CUTOFF)).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def by_contents(queries: DataFrame, expected: DataFrame, retrieved: DataFrame, k: int = CUTOFF) -> DataFrame:
    """Scores by what results say, not by their ids: ``(query_id, content_type, relevant_count, hits, retrieved_count, recall, precision, mrr)``.

    ``queries(query_id, content_type)``, ``expected(query_id, content)``, ``retrieved(query_id, rank, content)``. A result is a hit
    if its normalised content holds a normalised expected content, so several results may hit the same one and
    recall may pass 1; every expected content counts, repeats and blank ones included. Hits count to rank ``k``, the first hit at any rank.
    """
    wanted = expected.select("query_id", text.normalized(F.col("content")).alias("e"))
    counts = wanted.groupBy("query_id").agg(F.count("*").alias("relevant_count"))
    got = retrieved.select("query_id", "rank", text.normalized(F.col("content")).alias("c"))
    met = got.join(wanted.filter("e <> ''").distinct(), "query_id").filter(F.col("c").contains(F.col("e"))).select("query_id", "rank").distinct()
    met = met.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    out = queries.select("query_id", "content_type").join(counts, "query_id", "left").join(got.groupBy("query_id").agg(F.count("*").alias("retrieved_count")), "query_id", "left").join(met, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.select("query_id", "content_type", zero("relevant_count"), zero("hits"), zero("retrieved_count"), "first")
    recall = F.when(F.col("relevant_count") > 0, F.col("hits") / F.col("relevant_count")).otherwise(F.lit(0.0))
    return out.select("query_id", "content_type", "relevant_count", "hits", "retrieved_count", recall.alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def report(scores: DataFrame, mode: str, baseline: float | None = None) -> DataFrame:
    """``(kind, line)``: a JSON line for each query, and one with the means, for a text sink.

    The mean line says whether the reciprocal rank fell by more than DROP below ``baseline``, if there is one.
    """
    each = scores.select(F.lit("query").alias("kind"), F.to_json(F.struct(F.lit(mode).alias("mode"), "query_id", "recall", "precision", "mrr")).alias("line"))
    blocking = F.lit(None).cast("boolean") if baseline is None else F.col("mrr") < baseline - DROP
    return each.unionByName(averaged(scores).select(F.lit("mean").alias("kind"), F.to_json(F.struct(F.lit(mode).alias("mode"), "queries", "recall", "precision", "mrr", blocking.alias("blocking"))).alias("line")))
