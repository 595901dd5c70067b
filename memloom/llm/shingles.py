"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, one of each group kept.

Candidates come from the SimHash operator's multi-index hashing (fingerprints of five-word shingles, two bits apart at most)
and from bands of MinHash values. SimHash alone can't do: at 0.8 about ten of 64 bits differ, which no ball reaches
without listing a large part of all pairs. BANDS bands of ROWS minima find a pair of similarity 0.8 but for
(1 - 0.8^ROWS)^BANDS, 3 in 100,000, and any above more surely still. All candidates are verified on whole sets, so nothing
less similar is linked.

A band's texts are linked to the smallest of them. The links are verified, and after that every pair of texts that
share a band but not yet a component. So pairs inside a large group of near copies are never listed, and components are
those of all pairs found. Before whole sets are compared, parity sketches are: they differ in no more bits than the sets
differ in shingles. Where more than HOT texts share a band, their sketches are compared by matrix products, BLOCK by
BLOCK texts, and only the pairs that pass become rows. Texts with equal words are one, told by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import bounded
from memloom.llm.components import components
from memloom.llm.scratch import Scratch
from memloom.llm.simhash import LOWER, few, majority, one_of_each, whole_row
from memloom.llm.simhash import links as simhash_links

WORDS = 5
#: The least similarity, as a fraction.
LEAST, OF = 4, 5
BANDS, ROWS = 26, 5
#: Texts of a band whose pairs are listed one by one; of more, the sketches are compared in blocks.
HOT, BLOCK = 24, 512
#: Words of the sketches of two blocks that are compared at a time.
SLICE = 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SALT, _TIMES = (np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False) | np.uint64(1))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def text_key(found: list[bytes]) -> int:
    """One number for texts with the same words in the same order."""
    return xxhash.xxh64_intdigest(b" ".join(found), 7)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def every_shingle(found: list[bytes]) -> np.ndarray:
    """Hashes of the shingles, repeats included; texts of fewer words are one shingle."""
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(WORDS, n)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += mixed(hashes[i : n - k + 1 + i] * _ODD[i])
    return mixed(total)


def shingles(found: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(every_shingle(found))


def bands(held: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of ROWS minima over the set, each in an order of its own. None for the empty set."""
    if not len(held):
        return held
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(held), 2048):
        low = np.minimum(low, ((held[at : at + 2048, None] ^ _SALT) * _TIMES).min(axis=0))
    return mixed((mixed(low.reshape(BANDS, ROWS)) * _ODD).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(held: np.ndarray) -> bytes:
    """Parities of the shingles by hash, in a power of two of bits: at least twice as many as shingles, and 64."""
    bits = 64
    while bits < 2 * len(held):
        bits *= 2
    return np.packbits(np.bincount((held >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1 == 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only for sketches of sets (of n and m shingles) below the least similarity."""
    if LEAST * max(n, m) > OF * min(n, m):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n + m


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one length as rows of ``words`` 64-bit words."""
    x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row of ``x`` differs from each of ``y``; SLICE words at a time become numbers, however long the rows are."""

    def signs(z: np.ndarray) -> np.ndarray:
        return 1 - 2 * np.unpackbits(np.ascontiguousarray(z).view(np.uint8), axis=1).astype(np.float32)

    alike = np.zeros((len(x), len(y)), np.float32)  # whole numbers below 2**24
    for at in range(0, x.shape[1], SLICE):
        alike += signs(x[:, at : at + SLICE]) @ signs(y[:, at : at + SLICE]).T
    return (64 * x.shape[1] - alike) / 2


def likely(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """``(a, b)``: the pairs of ``(key, root, n, sketch)`` rows of different roots for which ``may_be_similar`` holds."""
    out = [np.empty((0, 2), np.int64)]
    for size, x in left.groupby(left["sketch"].map(len)):
        for other, y in right.groupby(right["sketch"].map(len)):
            if max(size, other) > 2 * min(size, other):
                continue  # so do their numbers of shingles, by more than similar sets do
            words = min(size, other) // 8
            apart = bits_apart(folded(list(x["sketch"]), words), folded(list(y["sketch"]), words))
            n, m = x["n"].to_numpy(np.int64)[:, None], y["n"].to_numpy(np.int64)[None]
            fits = (9 * apart <= n + m) & (LEAST * np.maximum(n, m) <= OF * np.minimum(n, m)) & (x["root"].to_numpy()[:, None] != y["root"].to_numpy()[None])
            i, j = np.nonzero(fits)
            out.append(np.stack((x["key"].to_numpy()[i], y["key"].to_numpy()[j]), axis=1))
    found = np.concatenate(out)
    found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], axis=1), axis=0)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def once(found: DataFrame) -> DataFrame:
    """One row per key of ``found(key, times, ...)``, whose rows of one key are equal; only keys of several rows are shuffled."""
    return found.filter("times = 1").union(found.filter("times > 1").dropDuplicates(["key"]))


def sketched(keys: DataFrame, known: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, n, sketch)`` of the texts of ``keys(key)``: ``known(key, row, times)`` names a row of each, ``rows`` holds its sketch."""
    asked = scratch.save(known.join(few(keys), "key", "left_semi").select("key", "row", "times"))
    return once(rows.select("key", "row", "n", "sketch").join(few(asked), ["key", "row"])).select("key", "n", "sketch")


def likely_pairs(placed: DataFrame, sizes: DataFrame, known: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)``: the likely pairs of ``placed(segment, key, root)`` in the segments of ``sizes(segment, size)``, block by block."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = placed.join(few(sizes), "segment").withColumn("of", blocks)
    facts = sketched(met.select("key").distinct(), known, rows, scratch)
    met = met.join(facts, "key").withColumn("at", F.pmod(F.xxhash64("key"), F.col("of")).cast("int"))
    base = ["segment", "key", "root", "n", "sketch"]
    first = met.select(*base, F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("of") - 1)).alias("j"), F.lit(True).alias("first"))
    second = met.select(*base, F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.lit(False).alias("first"))

    def one(table: pd.DataFrame) -> pd.DataFrame:
        return likely(table[table["first"]], table[~table["first"]])

    return first.union(second).groupBy("segment", "i", "j").applyInPandas(one, "a long, b long").distinct()


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= LEAST * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, known: DataFrame, rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The ``pairs(a, b)`` that have the least similarity; ``known`` and ``rows`` as for ``sketched``, ``texts(row, text)`` holds each text once at least.

    Sets move once for each link, and those of the links' smaller ends once more.
    """

    @F.pandas_udf("boolean")
    def near(x: pd.Series, n: pd.Series, y: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(*z) for z in zip(x, n, y, m, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(words(t)).tobytes() for t in texts], dtype=object)

    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    signed = scratch.save(sketched(ends, known, rows, scratch))
    found = pairs.join(signed.select(F.col("key").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x")), "a").filter("n > 0")
    found = found.join(signed.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    found = scratch.save(found.filter(f"{LEAST} * greatest(n, m) <= {OF} * least(n, m)").filter(near("x", "n", "y", "m")).select("a", "b"))
    asked = scratch.save(known.select("key", "row", "times").join(found.select(F.col("a").alias("key")).union(found.select("b")).distinct(), "key"))
    sets = texts.join(few(asked), "row").select("row", "key", "times", pack("text").alias("held"))
    sets = scratch.save(once(sets).select("key", "held"))
    heads = sets.join(few(found.select(F.col("a").alias("key")).distinct()), "key", "left_semi")
    held = found.join(sets.select(F.col("key").alias("b"), F.col("held").alias("y")), "b")
    held = held.join(heads.select(F.col("key").alias("a"), F.col("held").alias("x")), "a")
    return scratch.save(held.filter(udf("x", "y")).select("a", "b"))


def rooted(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """One row per row of ``docs``: ``(id, row, root)``, its id, a hash of the whole row, and its component."""
    bounded()
    row = whole_row(docs)

    @F.pandas_udf("key long, fp long, n int, sketch binary, band array<long>")
    def signs(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = words(t)
            every = every_shingle(found)
            held = np.unique(every)
            key, fp = np.array([text_key(found), majority(every) if len(every) else 0], np.uint64).view(np.int64)
            out.append((key, fp, len(held), sketch(held), bands(held).view(np.int64)))
        return pd.DataFrame(out, columns=["key", "fp", "n", "sketch", "band"])

    rows = scratch.save(docs.select(F.col(id_col).alias("id"), row.alias("row"), signs(F.col(text_col)).alias("c")).select("id", "row", "c.*"))
    texts = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    known = scratch.save(rows.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("fp").alias("fp")))

    prints = scratch.save(known.filter("n > 0").groupBy("fp").agg(F.min("key").alias("key")))
    near = simhash_links(prints.select("fp"), scratch)
    alike = near.join(prints.select(F.col("fp").alias("a"), F.col("key").alias("p")), "a").join(prints.select(F.col("fp").alias("b"), F.col("key").alias("q")), "b").select("p", "q")
    equal = known.filter("n > 0").select("fp", F.col("key").alias("q")).join(prints.select("fp", F.col("key").alias("p")), "fp").filter("p <> q").select("p", "q")
    alike = alike.union(equal).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    cuts = rows.select("key", F.explode("band").alias("segment"))
    shared = scratch.save(cuts.groupBy("segment").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("segment", "a"))
    met = scratch.save(cuts.join(few(shared), "segment").select("segment", "key", "a").distinct())
    stars = scratch.save(met.filter("a <> key").select("a", F.col("key").alias("b")).union(alike).distinct())
    edges = _verified(stars, known, rows, texts, scratch)
    label = components(edges, scratch).select(F.col("node").alias("key"), "label")
    placed = met.join(label, "key", "left").select("segment", "key", F.coalesce("label", "key").alias("root"))
    split = placed.groupBy("segment").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low <> high")
    split = scratch.save(split.select("segment", "size"))
    hot = scratch.save(likely_pairs(placed, split.filter(F.col("size") > HOT), known, rows, scratch))
    placed = scratch.save(placed.join(split.filter(F.col("size") <= HOT).select("segment"), "segment", "left_semi"))
    roots = placed.select("segment", "root").distinct()
    cross = roots.withColumnRenamed("root", "r").join(roots.withColumnRenamed("root", "s"), "segment").filter("r < s")
    cross = cross.join(placed.select("segment", F.col("root").alias("r"), F.col("key").alias("p")), ["segment", "r"])
    cross = cross.join(placed.select("segment", F.col("root").alias("s"), F.col("key").alias("q")), ["segment", "s"])
    pairs = cross.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).union(hot).distinct()
    pairs = scratch.save(pairs.join(stars, ["a", "b"], "left_anti"))
    edges = scratch.save(edges.union(_verified(pairs, known, rows, texts, scratch)))
    label = components(edges, scratch).select(F.col("node").alias("key"), "label")
    return rows.join(label, "key", "left").select("id", "row", F.coalesce("label", "key").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` left when one document of each component of similar texts stays: the smallest id.

    Columns as in ``docs``, none of them a map. Null text counts as empty, and texts without words are one
    component. A component keeps exactly one row, also where ids repeat or are null. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    return one_of_each(docs, rooted(docs, id_col, text_col, scratch), scratch)
