"""The tables of a store as Parquet, of which a batch rewrites the partitions it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import project
from memloom.sources.shared import new_folder, written

#: Each table's columns beside ``bank`` and ``part``, and the column whose hash is the part.
TABLES = {
    "memories": ("memory_id string, content string, importance double", "memory_id"),
    "files": ("id string, path string, source_type string, file_role string, file_hash string, language string, summary string, tags array<string>, metadata map<string,string>, total_chunks int, status string", "id"),
    "file_chunks": ("id string, file_id string, memory_id string, chunk_index int, start_line int, end_line int, section_header string, content_hash string, content_type string, is_partial boolean, parent_unit_ref string, parent_unit_summary string", "file_id"),
    "file_relations": ("id string, source_file_id string, target_file_id string, relation_type string, strength double, direction string, description string", "source_file_id"),
}


def merged_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` files with what only ``old`` knows: nulls filled, a known source type kept, tags and metadata united."""
    was = old.select("id", *[F.col(c).alias(f"__{c}") for c in old.columns if c != "id"])
    both = new.join(was, "id", "left")
    kept = [F.coalesce(c, f"__{c}").alias(c) for c in ("file_role", "file_hash", "language", "summary")]
    kind = F.when(F.col("source_type") != "unknown", F.col("source_type")).otherwise(F.coalesce("__source_type", "source_type")).alias("source_type")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    now = F.coalesce("metadata", none)
    stays = F.map_filter(F.coalesce("__metadata", none), lambda k, _: ~F.map_contains_key(now, k))
    both_maps = F.map_concat(stays, now)
    metadata = F.when(F.col("metadata").isNotNull() | F.col("__metadata").isNotNull(), both_maps).alias("metadata")
    out = both.select("id", "bank", "path", kind, *kept, text.merged_tags(F.col("__tags"), F.col("tags")).alias("tags"), metadata, "total_chunks", "status")
    return out.select(new.columns)


class Store:
    """Tables below one folder, in partitions by bank and ``part``, a hash of the file's (or memory's) id.

    A batch reads and rewrites the partitions of the files it touches, and no others: what it makes is written beside the
    tables first, then overwrites those partitions. Files are written last, and the batch's number after them, so a batch
    that was lost on its way can be given again, and one that was finished does nothing again. One writer at a time.
    Banks are not null. A partition that loses its last row keeps a mark, a row of nulls that ``read`` leaves out.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 16):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("part")

    def _raw(self, table: str) -> DataFrame:
        """A table with ``bank`` and ``part``."""
        ddl, key = TABLES[table]
        schema = f"{ddl}, bank string, part int"
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}") if self._exists(table) else self.spark.createDataFrame([], schema)
        return rows.filter(F.col(key).isNotNull())

    def read(self, table: str) -> DataFrame | None:
        """A table as it is; null before the first batch."""
        if not self._exists(table):
            return None
        rows = self._raw(table).drop("part")
        return rows if table in ("files", "memories") else rows.drop("bank")

    def last_batch(self) -> int:
        """The number of the newest finished batch; -1 before the first that had one."""
        return self.spark.read.schema("batch long").parquet(f"{self.folder}/batches").agg(F.max("batch")).first()[0] if self._exists("batches") else -1

    def _within(self, table: str, touched: DataFrame) -> DataFrame:
        """The rows in the partitions ``touched(bank, part)``; a list of them is small, so other partitions are not read."""
        return self._raw(table).join(F.broadcast(touched), ["bank", "part"], "left_semi")

    def _write(self, table: str, rows: DataFrame, touched: DataFrame, work: str) -> None:
        ddl, _ = TABLES[table]
        marked = rows.select(*self.spark.createDataFrame([], ddl).columns, "bank", "part").unionByName(touched, allowMissingColumns=True)
        ready = written(marked.repartition("bank", "part"), f"{work}/{table}")
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bank", "part").parquet(f"{self.folder}/{table}")

    def remember(self, rows: DataFrame, batch: int | None = None) -> None:
        """Add a batch of remembered rows ``(project)`` with ``content`` to memories and projection; a finished ``batch`` is skipped."""
        if batch is not None and batch <= self.last_batch():
            return
        work = new_folder(self.spark, "batch")
        # every table is made from the batch's rows, written once without their texts; files count the chunks that were written
        keyed = written(rows.drop("content").withColumn("file_id", text.file_id(F.col("bank"), F.col("path"))), f"{work}/rows")
        new = {"memories": rows.groupBy("bank", "memory_id").agg(F.first("content").alias("content"), F.max("importance").alias("importance")), "file_relations": project.relations_of(keyed)}
        new = {t: written(df, f"{work}/new-{t}") for t, df in (new | {"file_chunks": project.chunks_of(keyed)}).items()}
        new["files"] = written(project.files_of(keyed, new["file_chunks"]), f"{work}/new-files")
        told = new["files"].filter("status <> 'pending'")
        at = new["files"].select("id", "bank", self._part("id"))
        touched = written(at.select("bank", "part").distinct(), f"{work}/parts")
        old = self._within("files", touched)
        was = old.select("id", F.col("file_hash").alias("__h"))
        changed = was.join(told, "id").filter("__h is not null and not __h <=> file_hash").select(F.col("id").alias("file_id"))
        changed = written(changed, f"{work}/changed")
        memories = new["memories"].withColumn("part", self._part("memory_id"))
        places = written(memories.select("bank", "part").distinct(), f"{work}/places")
        self._write("memories", project.upsert(self._within("memories", places), memories, ["bank", "memory_id"]), places, work)
        chunks = new["file_chunks"].join(at.withColumnRenamed("id", "file_id"), "file_id")
        kept = self._within("file_chunks", touched).join(changed, "file_id", "left_anti")
        self._write("file_chunks", project.upsert(kept, chunks, project.KEYS["file_chunks"]), touched, work)
        relations = new["file_relations"].join(at.withColumnRenamed("id", "source_file_id"), "source_file_id")
        self._relations(changed, relations, work)
        counts = self._within("file_chunks", touched).groupBy(F.col("file_id").alias("id")).agg(F.count("*").cast("int").alias("__n"))
        stubs = new["files"].filter("status = 'pending'").join(old.select("id"), "id", "left_anti")
        files = project.upsert(old.drop("part"), merged_files(old.drop("part"), told), ["id"]).unionByName(stubs).join(counts, "id", "left")
        files = files.withColumn("total_chunks", F.coalesce("__n", F.lit(0))).drop("__n").withColumn("part", self._part("id"))
        self._write("files", files, touched, work)
        if batch is not None:
            self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.folder}/batches")

    def _relations(self, gone: DataFrame, new: DataFrame, work: str) -> None:
        """Relations with an end in ``gone(file_id)`` go, ``new`` ones come: the partitions of either are written."""
        every = self._raw("file_relations")
        lost = every.join(project.touching(every.drop("bank", "part"), gone).select(*project.KEYS["file_relations"]), project.KEYS["file_relations"], "left_semi")
        touched = written(lost.select("bank", "part").union(new.select("bank", "part")).distinct(), f"{work}/relation-parts")
        within = self._within("file_relations", touched)
        for side in ("source_file_id", "target_file_id"):
            within = within.join(gone.withColumnRenamed("file_id", side), side, "left_anti")
        self._write("file_relations", project.upsert(within, new, project.KEYS["file_relations"]), touched, work)

    def delete(self, file_ids: DataFrame) -> None:
        """Tombstones for ``file_ids(file_id)``: their chunks and relations go."""
        work = new_folder(self.spark, "delete")
        gone = written(file_ids.select("file_id").distinct(), f"{work}/gone")
        own = self._raw("files").join(gone.withColumnRenamed("file_id", "id"), "id", "left_semi")
        touched = written(own.select("bank", "part").distinct(), f"{work}/parts")
        self._write("file_chunks", self._within("file_chunks", touched).join(gone, "file_id", "left_anti"), touched, work)
        self._relations(gone, self._raw("file_relations").limit(0), work)
        marked = self._within("files", touched).join(gone.select(F.col("file_id").alias("id"), F.lit(True).alias("__gone")), "id", "left")
        files = marked.withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status")))
        self._write("files", files.withColumn("total_chunks", F.when(F.col("__gone"), 0).otherwise(F.col("total_chunks"))), touched, work)
