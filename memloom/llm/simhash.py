"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has two 32-bit segments, each with a table of its own: segment value to fingerprints. Two
fingerprints at a distance of at most two differ by at most one bit in the lower segment, or by none in the upper
(two in the lower leave none). So each looks up the Hamming ball of radius one around its lower and of radius zero around
its upper value, and the matches are verified on all 64 bits. A pair one bit apart is looked up from the side that
has the bit, which halves the ball.

A segment value that more than HEAVY distinct fingerprints share would match them all with each other. Those
fingerprints, and all one bit of that segment away, are matched on whole values instead: for a distance of at most
two a third 64-bit value exists within one bit of both, so each lists the 65 values within one bit, and those that
list one value are linked to the smallest of them. A value is listed by at most 65 distinct fingerprints, whatever
the data; no bucket of either kind is unbounded, and no pair is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.batches import bounded
from memloom.llm.components import components
from memloom.llm.scratch import Scratch

SEED = 42
#: Bits in which linked fingerprints may differ: one for each of the two segments' balls.
RADIUS = 2
#: Distinct fingerprints of one segment value that are still matched with each other.
HEAVY = 64
#: The most keys that are broadcast; a key takes about 30 bytes of an executor.
BROADCAST_KEYS = 1_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    k = min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - k + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long column."""
    bounded()

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return udf(text)


def entries(fingerprints: DataFrame) -> DataFrame:
    """The segment tables, ``(key, fp)``: the segment's number in the upper, its value in the lower 32 bits of ``key``."""
    keys = F.expr("array(fp & 4294967295L, shiftrightunsigned(fp, 32) | 4294967296L)")
    return fingerprints.select("fp", F.explode(keys).alias("key"))


def matches(table: DataFrame) -> DataFrame:
    """``(a, b)``: fingerprints whose lower segments differ by one bit at most, or their upper ones by none; not verified."""
    flips = "transform(filter(sequence(0, 31), i -> shiftrightunsigned(key, i) % 2 = 1), i -> key ^ shiftleft(1L, i))"
    ball = F.expr(f"if(key < 4294967296L, concat(array(key), {flips}), array(key))")
    probes = table.select(F.col("fp").alias("a"), F.col("key").alias("own"), F.explode(ball).alias("key"))
    found = probes.join(table.withColumnRenamed("fp", "b"), "key")
    return found.filter("own <> key or a < b").select("a", "b")


def linked_by_values(fingerprints: DataFrame) -> DataFrame:
    """``(a, b)``: edges that connect what chains of distances up to two connect, by the 65 values within one bit of each."""
    keys = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    table = fingerprints.select("fp", F.explode(keys).alias("key"))
    return table.select("fp", F.min("fp").over(Window.partitionBy("key")).alias("a")).filter("a <> fp").select("a", F.col("fp").alias("b"))


def links(fingerprints: DataFrame, scratch: Scratch) -> DataFrame:
    """``(fp)`` distinct → ``(a, b)``: edges that connect exactly what chains of distances up to two connect."""
    table = entries(fingerprints)
    heavy = scratch.save(table.groupBy("key").count().filter(F.col("count") > HEAVY).select("key"))
    found = None
    if not heavy.isEmpty():
        around = F.expr("concat(array(key), transform(sequence(0, 31), i -> key ^ shiftleft(1L, i)))")
        near = table.join(heavy.select(F.explode(around).alias("key")).distinct(), "key", "left_semi")
        found = linked_by_values(scratch.save(near.select("fp").distinct()))
        table = scratch.save(table.join(heavy, "key", "left_anti"))
    every = matches(table) if found is None else matches(table).union(found)
    return every.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint, and the smallest id reachable over links.

    ``(doc_id, fingerprint, component_id, fp, root)``; ``fp`` and ``root`` are the
    fingerprints as longs. Null text counts as empty; texts without words share the
    fingerprint zero and so one component. Rows with a null id take part; a component of
    null ids alone has a null ``component_id``. Repeated rows come back repeated, and texts are read
    whole, however long. ``row``: a long that is carried along as the column ``row``.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    more = [] if row is None else [row.alias("row")]
    prints = scratch.save(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"), *more))
    least = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.save(links(least.select("fp"), scratch).distinct())
    label = components(edges, scratch).select(F.col("node").alias("fp"), F.col("label").alias("root"))
    rooted = scratch.save(least.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.save(rooted.select("fp", "root").join(ids, "root"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", *["row" for _ in more]
    )


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns, none of them a map."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` left when each root of ``rows(id, row, root)`` keeps one: the smallest id, nulls last.

    ``row`` hashes the whole row. What goes is decided on ids and hashes alone. Rows equal in every column, more than one
    of a kind, are the only texts that are shuffled; the others go by an anti join with the keys that go, broadcast while
    they are at most BROADCAST_KEYS.
    """
    rows = scratch.save(rows)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    firsts = rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    many = rows.join(firsts.filter("n > 1").select("root", "first"), "root")
    many = scratch.save(many.groupBy("row").agg(F.max((F.col("row") == F.col("first.row")).cast("int")).alias("stays"), F.count("*").alias("times")))
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = many.filter("stays = 0").select(F.col("row").alias(name))
    repeated = many.filter("stays = 1 and times > 1").select(F.col("row").alias(name))
    marked = docs.withColumn(name, whole_row(docs))
    single = marked.join(few(gone.union(repeated)), name, "left_anti")
    again = marked.join(few(repeated), name, "left_semi").dropDuplicates([name])
    own = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*own).union(again.select(*own))


def few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if they are at most BROADCAST_KEYS, else left to a shuffle join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` left when one document of each component stays: the smallest id.

    Columns as in ``docs``. Each component keeps exactly one row, also where ids repeat or are null.
    """
    classes = near_duplicates(docs, id_col, text_col, shingle, whole_row(docs))
    return one_of_each(docs, classes.select(F.col("doc_id").alias("id"), "row", "root"), Scratch(docs.sparkSession, "keep"))
