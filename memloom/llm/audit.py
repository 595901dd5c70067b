r"""Filter interaction audit: how five filters overlap, in every order, from one histogram of failure masks.

A text's mask has a bit for each filter it fails, built by native expressions; the bit of repeated texts needs the
smallest doc_id with a text, found by a pre-aggregated ``groupBy`` of digests. Masks are counted by part in at most
32 cells (with the labelled documents among them), and all 120 orders are enumerated from the cells: the documents
removed at a step are those whose mask holds the step's bit and none of an earlier step.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "ABCDE"
#: Least words; least distinct words and most capitals in hundredths; characters of junk.
WORDS, DISTINCT, CAPITALS, JUNK = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D, 1, 2, 4 and 8, for the whole text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT * n, 100 * capitals > CAPITALS * F.length(text), text.rlike(JUNK)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic)`` of every document: its lang (null: empty), the failed filters' bits, and whether a label row of its id has quality 1, toxic 1.

    E: another row with the same text has a smaller doc_id; a null doc_id is neither smaller nor fails.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(F.col("text")).alias("own"), digest.alias("digest"))
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    # equal on text and id at once, so a text that a third of all rows hold is spread by its ids
    first = first.select(F.col("first").alias("f_id"), F.col("digest").alias("f_digest"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, (F.col("doc_id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left").join(marks, F.col("doc_id") == F.col("l_id"), "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("f_id").isNull(), 16).otherwise(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    return rows.select("part", (F.col("own") + again).alias("mask"), flag("good").alias("good"), flag("toxic").alias("toxic"))


def cells(marked: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: at most 32 rows for each part."""
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the cells."""
    histogram = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 each
    steps = [(("".join(p)), k + 1, 1 << LETTERS.index(p[k]), sum(1 << LETTERS.index(x) for x in p[:k])) for p in permutations(LETTERS) for k in range(5)]
    every = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, k, bit, before in steps])).alias("s")
    rows = histogram.select("part", "cells", every).select("part", "cells", "s.*")

    def total(field: str, cond) -> Column:
        return F.aggregate(F.filter("cells", cond), F.lit(0).cast("long"), lambda out, c: out + c[field])

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    passed = lambda c: c["mask"].bitwiseAND(F.col("before")) == 0
    removed = lambda c: fails(c) & passed(c)
    out = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda c: ~fails(c) & passed(c)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda c: fails(c) & ~passed(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == F.col("bit")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: 600 rows for each part.

    ``docs`` has doc_id, text, lang; ``labels`` doc_id, quality, toxic; other columns are not read. Null text counts as
    empty, null lang is the part ''. A document of repeated label rows is good if any says so. Repeated rows count as
    often as they are there and do not make each other fail E, their ids being equal. An empty table gives no rows.
    """
    return orders(cells(masks(docs, labels)))
