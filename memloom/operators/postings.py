"""A trigram index of files: full-text questions read the postings of their own trigrams, not the files.

Two tables below one folder. ``postings/slot=…`` has one row for each place of a trigram in a file's text,
``(gram, id, at, batch)``: ``slot`` is a hash of the trigram, so a question reads the slots of its trigrams, and rows are
sorted by trigram inside a file of a slot, so row groups of other trigrams are left out. Rows are dealt by ranges of
(slot, gram, id), which splits a trigram that every file has. ``heads/`` has ``(id, batch, len, live, document)``: a file's
newest batch alone counts. An update appends the touched files' postings and heads under a new batch and rewrites nothing;
``compact`` drops what no longer counts.

A file holds a text if each of its trigrams stands at the right distance from one start; places tell that, so no text is
read again. Candidates come from the rarest trigrams first.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text

BM25_K1, BM25_B = 1.2, 0.75
#: Trigrams that candidates are intersected over, rarest first, before places are compared.
ROUNDS = 3


def grams_of(document: Column) -> Column:
    """The trigrams of a text in order, by code points."""
    starts = F.when(F.length(document) >= 3, F.sequence(F.lit(1), F.length(document) - 2))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(document, i, 3))


class TrigramIndex:
    """Postings of ``files(id, path, keywords, tags)`` below ``folder``; ``slots`` is fixed when the index is built."""

    def __init__(self, spark: SparkSession, folder: str, slots: int = 64):
        self.spark, self.folder, self.slots = spark, folder.rstrip("/"), slots

    def _slot(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.slots)).cast("int")

    def _append(self, files: DataFrame, batch: int, mode: str) -> None:
        document = text.file_document(F.col("path"), F.col("keywords"), F.col("tags"))
        held = files.select("id", document.alias("document")).groupBy("id").agg(F.max("document").alias("document"))
        size = F.greatest(F.length("document") - 2, F.lit(0))
        held.select("id", F.lit(batch).alias("batch"), size.alias("len"), F.lit(True).alias("live"), "document").write.mode(mode).parquet(f"{self.folder}/heads")
        # the texts are put together once; their postings come from what was written
        new = self._read("heads").filter(F.col("batch") == batch).select("id", F.posexplode(grams_of(F.col("document"))).alias("at", "gram"))
        rows = new.select(self._slot(F.col("gram")).alias("slot"), "gram", "id", "at", F.lit(batch).alias("batch"))
        rows.repartitionByRange("slot", "gram", "id").sortWithinPartitions("slot", "gram", "id").write.mode(mode).partitionBy("slot").parquet(f"{self.folder}/postings")

    def build(self, files: DataFrame) -> TrigramIndex:
        """Index all ``files``; of rows with one id the largest text counts, null keywords and tags are empty."""
        self._append(files, 0, "errorifexists")
        return self

    def _next(self) -> int:
        return self._read("heads").agg(F.max("batch")).first()[0] + 1

    def _read(self, table: str) -> DataFrame:
        fields = {"heads": "id string, batch int, len int, live boolean, document string", "postings": "gram string, id string, at int, batch int, slot int"}[table]
        return self.spark.read.schema(fields).parquet(f"{self.folder}/{table}")

    def update(self, files: DataFrame) -> None:
        """Files added or changed: their own postings alone are written."""
        self._append(files, self._next(), "append")

    def remove(self, ids: DataFrame) -> None:
        """``ids(id)`` are found no more."""
        ids.select("id").distinct().select("id", F.lit(self._next()).alias("batch"), F.lit(0).alias("len"), F.lit(False).alias("live"), F.lit(None).cast("string").alias("document")).write.mode("append").parquet(f"{self.folder}/heads")

    def heads(self) -> DataFrame:
        """``(id, batch, len)`` of the files that are there."""
        newest = self._read("heads").groupBy("id").agg(F.max_by(F.struct("batch", "len", "live"), "batch").alias("h"))
        return newest.select("id", "h.*").filter("live").drop("live")

    def postings(self, grams: list[str] | None = None) -> DataFrame:
        """Live ``(gram, id, at)``, of ``grams`` alone if they are given."""
        rows = self._read("postings")
        if grams is not None:
            # the slots as plain numbers, so that other folders are not read; the hash is Spark's, which counts as signed
            hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
            slots = sorted({(h - (h >> 63 << 64)) % self.slots for h in hashed})
            rows = rows.filter(F.col("slot").isin(slots) & F.col("gram").isin(grams))
        return rows.join(self.heads().select("id", "batch"), ["id", "batch"], "left_semi").select("gram", "id", "at")

    def compact(self, folder: str) -> TrigramIndex:
        """The same index without dead rows, written below another folder."""
        rows = self.postings().select(self._slot(F.col("gram")).alias("slot"), "gram", "id", "at", F.lit(0).alias("batch"))
        rows.repartitionByRange("slot", "gram", "id").sortWithinPartitions("slot", "gram", "id").write.partitionBy("slot").parquet(f"{folder}/postings")
        kept = self._read("heads").join(self.heads().select("id", "batch"), ["id", "batch"], "left_semi")
        kept.select("id", F.lit(0).alias("batch"), "len", "live", "document").write.parquet(f"{folder}/heads")
        return TrigramIndex(self.spark, folder, self.slots)

    def _asked(self, query: str) -> tuple[list[str], dict[str, int], DataFrame]:
        """The lower-cased query's trigrams in order, how many files have each, and the files that hold the query."""
        wanted = query.lower()
        grams = [wanted[i : i + 3] for i in range(len(wanted) - 2)]
        rows = self.postings(sorted(set(grams)))
        count = {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.count_distinct("id").alias("n")).collect()}  # one row for each trigram asked
        if len(count) < len(set(grams)) or not grams:
            return grams, count, self.heads().select("id").limit(0)
        rare = sorted(count, key=lambda g: (count[g], g))
        found = self.postings(rare[:1]).select("id").distinct()
        for g in rare[1:ROUNDS]:
            found = found.join(self.postings([g]).select("id"), "id", "left_semi")
        offsets = F.create_map(*[x for g in rare for x in (F.lit(g), F.array(*[F.lit(i) for i, h in enumerate(grams) if h == g]))])
        starts = rows.join(found, "id", "left_semi").select("id", "at", F.explode(F.element_at(offsets, F.col("gram"))).alias("offset"))
        starts = starts.groupBy("id", (F.col("at") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
        return grams, count, starts.filter(F.col("n") == len(grams)).select("id").distinct()

    def search(self, query: str) -> DataFrame:
        """``(id)`` of the files that hold ``query`` in any case; none for one of under three characters."""
        return self._asked(query)[2]

    def ranked(self, query: str) -> DataFrame:
        """``(id, score)`` of the files that hold ``query``, best first, by BM25 over its trigrams; ties to the smaller id."""
        grams, count, found = self._asked(query)
        heads = self.heads()
        total = heads.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        n, mean = total["n"], max(total["mean"] or 1.0, 1.0)
        weigh = F.create_map(*[x for g, d in count.items() for x in (F.lit(g), F.log(F.lit((n - d + 0.5) / (d + 0.5) + 1)))]) if count else F.create_map().cast("map<string,double>")
        tf = self.postings(sorted(set(grams))).join(found, "id", "left_semi").groupBy("id", "gram").agg(F.count("*").alias("tf")).join(heads.select("id", "len"), "id")
        part = F.element_at(weigh, F.col("gram")) * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.lit(mean)))
        return tf.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id")
