"""Directories of files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import classify

FILE_FIELDS = "path string, modificationTime timestamp, length long, content binary"


def _plain(files: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", r"^[a-zA-Z][\w+.-]*:(//[^/]*)?(?=/)", "")
    return files.select(path.alias("path"), "modificationTime", F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), F.decode("content", "utf-8").alias("content"))


def scan(spark: SparkSession, folder: str, ignore: list[str] = (), pattern: str | None = None) -> DataFrame:
    """``(path, modificationTime, size, file_hash, content)`` of every file below ``folder`` that is not ignored."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = _plain((reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder))
    return files.filter(~classify.is_ignored(F.col("path"), list(ignore)))


def watch(spark: SparkSession, folder: str, ignore: list[str] = (), files_per_batch: int = 1000) -> DataFrame:
    """``scan`` as a stream: files that appear after the start."""
    reader = spark.readStream.format("binaryFile").schema(FILE_FIELDS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    return _plain(reader.load(folder)).filter(~classify.is_ignored(F.col("path"), list(ignore)))


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, op)``: what changed between two listings ``(path, file_hash)``: add, change or delete."""
    old, new = before.select("path", F.col("file_hash").alias("__o")), after.select("path", F.col("file_hash").alias("__n"))
    both = old.withColumn("__was", F.lit(True)).join(new.withColumn("__is", F.lit(True)), "path", "full_outer")
    op = F.when(F.col("__was").isNull(), "add").when(F.col("__is").isNull(), "delete").when(~F.col("__o").eqNullSafe(F.col("__n")), "change")
    return both.select("path", op.alias("op")).filter("op is not null")


def depth(root: Column, path: Column) -> Column:
    """Folders between ``root`` and a file below it: 1 for a file right in it."""
    below = path.substr(F.length(root) + 2, F.length(path))
    return F.size(F.split(below, "/"))


def bounded_walk(catalogue: DataFrame, depth_limit: int = 4, file_limit: int = 200, deep_first: bool = False) -> DataFrame:
    """``catalogue(root, path)`` down to ``depth_limit`` folders and at most ``file_limit`` files of each root.

    Shallow files come first, or, with ``deep_first``, entries by name with each folder's own entries in its place, as a
    walk meets them that goes into every folder it comes to. That order is the order of the paths' parts, one by one.
    Files beyond the limit go before the shuffle, so that a root of any size passes no more than that from each task.
    """
    inside = catalogue.filter(F.col("path").startswith(F.concat(F.col("root"), F.lit("/")))).withColumn("depth", depth(F.col("root"), F.col("path")))
    parts = F.split(F.col("path").substr(F.length("root") + 2, F.length("path")), "/")
    order = Window.partitionBy("root").orderBy(*([parts] if deep_first else ["depth", "path"]))
    return inside.filter(F.col("depth") <= depth_limit).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= file_limit).drop("n")
