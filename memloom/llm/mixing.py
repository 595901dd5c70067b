"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, in code-point order with null last, weigh 3, 1, 2 and again; together
they get 150 % of all words; a source stops at twice its own words and the excess is shared
anew by weight. Selection: a source takes every document once for each whole epoch
``floor(target / size)``; the rest of the budget goes to documents in the order of their keys
``-ln(u) / weight`` (smallest first), u from a hash of the row and weight its quality score, in steps of 1 / LEVELS.
The score comes from the row's own text, so weights need no join, at any size.

No source is sorted in one task. Keys fall into BINS of equal probability for the smallest weight,
so that of no weight more than ``LEVELS / BINS`` of the documents share a bin; sizes are summed by (source, bin)
before the shuffle and prefix-summed over bins; only the one bin a budget ends in is ordered row by row, rows
equal in id and text counted as one entry. What the budget has left before its border document goes to the one entry beyond
whose words come nearest to it, so that a long document on the border does not decide how near a target is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.scratch import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BINS = 2048
LEVELS = 16
#: More sources than these are not broadcast; each is a row of about 60 bytes.
BROADCAST_SOURCES = 100_000
#: Rows that come of one entry at a time.
REPEATS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Target words by source. ``sizes`` has one row per source."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    size, weight = dict(sizes), {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    budget, fixed, open_ = SHARE * sum(size.values()), {}, list(order)
    while open_:
        left = budget - math.fsum(fixed.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > CAP * size[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        fixed |= {s: CAP * size[s] for s in over}
        open_ = [s for s in open_ if s not in fixed]
    return fixed


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns' text; the same in every run."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def digest() -> Column:
    """The MD5 of the text, empty for null."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def keyed(rows: DataFrame, score: Column, tie: str) -> DataFrame:
    """``rows`` with ``__key`` and ``__bin``: the sampling key, from doc_id, the column ``tie`` and the weight, and its bin."""
    weight = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.round(score * LEVELS))) / LEVELS
    place = F.least(F.floor((1 - F.exp(-F.col("__key") / LEVELS)) * BINS), F.lit(BINS - 1)).cast("int")
    return rows.withColumn("__key", -F.log(uniform(F.col("doc_id"), F.col(tie))) / weight).withColumn("__bin", place)


def planned(docs: DataFrame, score: Column, scratch: Scratch) -> tuple[DataFrame, list[tuple]]:
    """Rows ``(doc_id, source, size, tie, key, bin)``, and for each source ``(source, source_size, target, epochs, budget, cut, before)``.

    ``budget``: words beyond the whole epochs; ``cut``: the bin in which it ends; ``before``: the words of the bins before that.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), digest().alias("tie"), score.alias("__score"))
    rows = keyed(rows, F.col("__score"), "tie").drop("__score")
    rows = scratch.save(rows.withColumnsRenamed({"__key": "key", "__bin": "bin"}))
    sums = scratch.save(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    sizes = {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("words")).collect()}
    budgets = []
    for source, target in targets(list(sizes.items())).items():
        epochs = min(int(CAP), math.floor(target / sizes[source])) if sizes[source] else 0
        budgets.append((source, sizes[source], float(target), epochs, float(target - epochs * sizes[source])))
    plan = docs.sparkSession.createDataFrame(budgets, "__p string, source_size long, target double, epochs int, budget double")
    upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    ends = with_plan(upto, plan, len(budgets)).filter("upto > budget").groupBy("source").agg(F.min("bin").alias("cut"), F.min(F.col("upto") - F.col("words")).alias("before"))
    ends = {r["source"]: (r["cut"], r["before"]) for r in ends.collect()}
    return rows, [b + ends.get(b[0], (BINS, None)) for b in budgets]


def with_plan(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """``rows`` with their source's plan: broadcast, or a shuffle join where the hot source is left to the adaptive skew join."""
    return rows.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, F.col("source").eqNullSafe(F.col("__p")))


def decided(rows: DataFrame) -> DataFrame:
    """The entries of the bin a budget ends in: rows equal in id and text, their number ``n``, and how many are ``chosen``."""
    entry = rows.filter("bin = cut").groupBy("source", "key", "doc_id", "tie", "size", "source_size", "target", "epochs", "budget", "before").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.col("budget") - F.col("before") - (F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n"))
    return entry.withColumn("chosen", F.when(F.col("size") > 0, F.least(F.col("n"), F.greatest(F.lit(0), F.floor(rest / F.col("size"))))).otherwise(0).cast("long"))


def nearest(joined: DataFrame, entries: DataFrame, plan: list[tuple], spark) -> dict:
    """Source → ``(key, doc_id, tie)`` of the entry beyond the border whose words come nearest to what the budget has left, if that is better than to leave it."""
    within = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("chosen")).alias("words"), F.min(F.when(F.col("chosen") < F.col("n"), F.struct("key", "doc_id", "tie"))).alias("border"))
    ends = {r["source"]: (r["words"], r["border"]) for r in within.collect()}  # one row for each source
    kind = joined.schema["doc_id"].dataType.simpleString()
    left = [(p[0], float(p[4] - p[6] - ends[p[0]][0]), ends[p[0]][1]) for p in plan if p[0] in ends and p[6] is not None]
    left = spark.createDataFrame([(s, r, None if b is None else tuple(b)) for s, r, b in left], f"__p string, left double, border struct<key:double,doc_id:{kind},tie:string>")
    rows = with_plan(joined.filter("bin >= cut and size > 0").select("source", "bin", "cut", "key", "doc_id", "tie", "size"), left, len(plan))
    beyond = (F.col("bin") > F.col("cut")) | (F.struct("key", "doc_id", "tie") >= F.col("border"))
    rows = rows.filter(beyond & (F.abs(F.col("left") - F.col("size")) < F.col("left"))).groupBy("source", "key", "doc_id", "tie", "size", "left").agg(F.count("*").alias("n"))
    off = F.abs(F.col("left") - F.col("size") * F.col("n"))
    best = rows.filter(off < F.col("left")).groupBy("source").agg(F.min_by(F.struct("key", "doc_id", "tie"), F.struct(off, "key", "doc_id", "tie")).alias("e"))
    return {r["source"]: tuple(r["e"]) for r in best.collect()}


def apart(entries: DataFrame) -> DataFrame:
    """One row for each row of an entry, the first ``chosen`` ones with ``chosen`` 1, the others 0."""
    runs = entries.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))))
    one = F.explode(F.sequence(F.col("__from"), F.least(F.col("n"), F.col("__from") + REPEATS) - 1))
    return runs.withColumn("__i", one).withColumn("chosen", (F.col("__i") < F.col("chosen")).cast("int"))


PLAN = "__p string, source_size long, target double, epochs int, budget double, cut int, before long"


def mix(docs: DataFrame, score: Column) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken, copies, tie)`` for every row of ``docs``.

    ``docs`` has doc_id, text, source; ``score`` is a column over it between 0 and 1, the quality. ``tie`` is the
    MD5 of the text. Null text has size 0 and takes 0; the null source is one of its own, last in order. A source
    whose words are all 0 has the target 0. Of rows that repeat in every column one may be taken without the other.
    An empty table gives an empty result, and texts of any length are counted whole. Documents are
    taken in the order of their keys as long as they fit, and one more, the nearest to what is left. What reaches the driver is one row for each source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows, plan = planned(docs, score, scratch)
    joined = with_plan(rows, spark.createDataFrame(plan, PLAN), len(plan))
    entries = scratch.save(decided(joined))
    extra = nearest(joined, entries, plan, spark)
    out = joined.filter("bin <> cut").withColumn("chosen", (F.col("bin") < F.col("cut")).cast("int"))
    names = ["doc_id", "size", "source", "source_size", "target", "epochs", "chosen", "tie", "key"]
    out = out.select(*names).union(apart(entries).select(*names))
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = spark.createDataFrame([(p[0], extra.get(p[0])) for p in plan], f"__p string, __extra struct<key:double,doc_id:{kind},tie:string>")
    out = with_plan(out, more, len(plan))
    chosen = F.when(F.struct("key", "doc_id", "tie").eqNullSafe(F.col("__extra")), 1).otherwise(F.col("chosen"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + chosen).otherwise(0)
    return out.select("doc_id", "size", "source", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "tie")


def take(docs: DataFrame, score: Column) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it is taken; columns as in ``docs``, ``score`` as in ``mix``.

    A source's choice within its last bin ends at one entry, and one entry more is named, so a row tells its copies from its own
    key and its source's plan: texts are never shuffled. Rows equal in id and text are taken alike, as the more of them are.
    Null texts and texts without words are never taken; null ids and the null source take part like any other. Texts of any
    length are counted whole, columns may have any names, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "take")
    rows, plan = planned(docs, score, scratch)
    joined = with_plan(rows, spark.createDataFrame(plan, PLAN), len(plan))
    split = scratch.save(decided(joined))
    extra = nearest(joined, split, plan, spark)
    last = split.filter("2 * chosen >= n and chosen > 0").groupBy("source").agg(F.max(F.struct("key", "doc_id", "tie")).alias("last"))
    last = {r["source"]: tuple(r["last"]) for r in last.collect()}  # at most one row for each source
    id_type = docs.schema["doc_id"].dataType.simpleString()
    entry = f"struct<key:double,doc_id:{id_type},tie:string>"
    ends = spark.createDataFrame([(p[0], p[3], p[5], last.get(p[0]), extra.get(p[0])) for p in plan], f"__p string, __epochs int, __cut int, __last {entry}, __extra {entry}")
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "source", digest().alias("tie"), score.alias("score"), F.col("text").rlike(WORD).alias("words"))
    placed = with_plan(keyed(whole, F.col("score"), "tie"), ends, len(plan))
    own = F.struct(F.col("__key").alias("key"), "doc_id", "tie")
    chosen = F.when(F.col("__bin") < F.col("__cut"), 1).when((F.col("__bin") == F.col("__cut")) & (own <= F.col("__last")), 1).when(own.eqNullSafe(F.col("__extra")), 1).otherwise(0)
    copies = F.when(F.col("words"), F.col("__epochs") + chosen).otherwise(0)
    return placed.select("doc", copies.alias("n")).filter("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")
