"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, folds: int, held: int) -> list[tuple[str, int]]:
    """At most ``per_class`` texts for each label value 0 and 1, from rows outside fold ``held``.

    Ids are drawn by hash order from the labels of ids that ``docs`` has, and the texts then fetched; of an
    id's repeated labels or texts the smallest counts. Texts over ``max_chars`` are left out of the sample.
    Ids are of any type that can be compared; the labels' are cast to the documents'. Both bounds are
    parameters, so what reaches the driver is bounded.
    """
    kind = docs.schema["doc_id"].dataType
    known = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(label).alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(fold_of(F.col("doc_id"), folds) != held)
    known = known.groupBy("doc_id").agg(F.min("y").cast("int").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    drawn = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.union(part)
    ids = {r["doc_id"]: r["y"] for r in drawn.collect()}
    if not ids:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], StructType([StructField("__id", kind)])))  # at most 2 * per_class rows
    texts = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(wanted, F.col("doc_id") == F.col("__id"), "left_semi")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"], ids[r["doc_id"]]) for r in sorted(rows, key=lambda r: r["doc_id"])]
