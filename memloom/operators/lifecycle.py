"""One object at a time, for many at once: aggregates by id, removals with their outcome, decisions of an upsert, states.

Every operator takes the requests as a table and answers each with a row, so an absent object is an outcome, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text
from memloom.operators import project

#: The ten keys of a file's block.
BLOCK = "id path source_type file_role total_chunks keywords tags average_importance metadata file_hash".split()
CHUNK_FIELDS = "start_line end_line content_hash section_header parent_unit_summary".split()


def file_block(files: DataFrame) -> Column:
    """The block of a file that answers carry: its ten keys, those ``files`` has no column for null, and no role as empty."""
    kinds = {"total_chunks": "int", "keywords": "array<string>", "tags": "array<string>", "average_importance": "double", "metadata": "map<string,string>"}
    one = lambda k: F.coalesce(k, F.lit("")) if k == "file_role" else F.col(k) if k in files.columns else F.lit(None).cast(kinds.get(k, "string"))
    return F.struct(*[one(k).alias(k) for k in BLOCK])


def get_files(tables: dict[str, DataFrame], asked: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``(file_id, status, file, chunks, relations)`` for each of ``asked(file_id)``: found or FILE_NOT_FOUND.

    ``chunks``: memory ids in order. ``relations``: ids at either end, of ``kinds`` if given, in order.
    """
    own = asked.select("file_id").distinct()
    files = tables["files"].select(F.col("id").alias("file_id"), file_block(tables["files"]).alias("file"))
    held = tables["file_chunks"].join(own, "file_id", "left_semi").groupBy("file_id")
    chunks = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "start_line", "memory_id"))), lambda x: x.memory_id).alias("chunks"))
    near = project.touching(tables["file_relations"], own)
    near = near if kinds is None else near.filter(F.col("relation_type").isin(kinds))
    ends = near.select(F.explode(F.array_distinct(F.array("source_file_id", "target_file_id"))).alias("file_id"), "id")
    relations = ends.join(own, "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list("id")).alias("relations"))
    out = own.join(files, "file_id", "left").join(chunks, "file_id", "left").join(relations, "file_id", "left")
    none = F.array().cast("array<string>")
    return out.select("file_id", F.when(F.col("file").isNull(), "FILE_NOT_FOUND").otherwise("found").alias("status"), "file", F.coalesce("chunks", none).alias("chunks"), F.coalesce("relations", none).alias("relations"))


def files_by_age(files: DataFrame, limit: int) -> DataFrame:
    """``files(id, path, created_at)``, the newest first, at most ``limit``; of one moment the smaller path first."""
    return files.select("id", "path", "created_at").orderBy(F.desc("created_at"), "path").limit(limit)


def relations_between(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """The relations from the first to the second file of ``pairs(source_file_id, target_file_id)``."""
    return relations.join(pairs.select("source_file_id", "target_file_id").distinct(), ["source_file_id", "target_file_id"], "left_semi")


def remove_chunks(tables: dict[str, DataFrame], asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asked(file_id, memory_id)`` removed: ``(file_id, memory_id, status)`` — removed, CHUNK_NOT_FOUND or FILE_NOT_FOUND — and the chunks left."""
    want = asked.select("file_id", "memory_id").distinct()
    files = tables["files"].select(F.col("id").alias("file_id"), F.lit(1).alias("__f"))
    there = tables["file_chunks"].select("file_id", "memory_id", F.lit(1).alias("__c"))
    out = want.join(files, "file_id", "left").join(there, ["file_id", "memory_id"], "left")
    status = F.when(F.col("__f").isNull(), "FILE_NOT_FOUND").when(F.col("__c").isNull(), "CHUNK_NOT_FOUND").otherwise("removed")
    return out.select("file_id", "memory_id", status.alias("status")), project.without(tables["file_chunks"], want, ["file_id", "memory_id"])


def rebuilt(tables: dict[str, DataFrame], files: DataFrame, keep: DataFrame) -> dict[str, DataFrame]:
    """The tables after ``files(file_id)`` changed: of their chunks those in ``keep(file_id, memory_id)`` stay, all their relations go."""
    own = files.select("file_id").distinct()
    others = tables["file_chunks"].join(own, "file_id", "left_anti")
    kept = tables["file_chunks"].join(own, "file_id", "left_semi").join(keep.select("file_id", "memory_id").distinct(), ["file_id", "memory_id"], "left_semi")
    relations = tables["file_relations"]
    for side in ("source_file_id", "target_file_id"):
        relations = relations.join(own.withColumnRenamed("file_id", side), side, "left_anti")
    return tables | {"file_chunks": others.unionByName(kept), "file_relations": relations.select(tables["file_relations"].columns)}


def forget(memories: DataFrame, tables: dict[str, DataFrame], asked: DataFrame, banks: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Memories of ``asked(bank, memory_id)`` forgotten: the outcomes, the memories left, and the tables left.

    Only banks of ``banks(bank, bank_type)`` with the type pure_memories allow it: others, and unknown ones, are
    MEMORY_BANK_NOT_SUPPORTED; then deleted or not_found. What is deleted takes its chunks along, and files left without any.
    """
    want = asked.select("bank", "memory_id").distinct().join(banks.select("bank", "bank_type"), "bank", "left")
    there = memories.select("bank", "memory_id", F.lit(1).alias("__m"))
    status = F.when(F.coalesce(F.col("bank_type") != "pure_memories", F.lit(True)), "MEMORY_BANK_NOT_SUPPORTED").when(F.col("__m").isNull(), "not_found").otherwise("deleted")
    out = want.join(there, ["bank", "memory_id"], "left").select("bank", "memory_id", status.alias("status"))
    gone = out.filter("status = 'deleted'")
    return out, project.without(memories, gone, ["bank", "memory_id"]), project.forget(tables, gone)


def chunk_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, memory_id, decision)`` of upserting the chunks ``new`` over ``old``.

    insert; replace, where the index differs; update, where a field that ``new`` knows differs; else none.
    """
    keys = ["file_id", "memory_id"]
    both = new.select(*keys, F.col("chunk_index").alias("__i"), *[F.col(c).alias(f"__{c}") for c in CHUNK_FIELDS]).join(old.select(*keys, "chunk_index", *CHUNK_FIELDS), keys, "left")
    differs = F.lit(False)
    for c in CHUNK_FIELDS:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    decision = F.when(F.col("chunk_index").isNull(), "insert").when(F.col("__i") != F.col("chunk_index"), "replace").when(differs, "update").otherwise("none")
    return both.select(*keys, decision.alias("decision"))


def relation_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, source_file_id, target_file_id, relation_type, decision)`` of upserting the relations ``new(file_id, ...)`` of files over ``old``.

    RELATION_SOURCE_MISMATCH, where the source is not the file itself; insert; update, where strength or description differ, a
    null description clearing the old one; else none.
    """
    keys = ["source_file_id", "target_file_id", "relation_type"]
    both = new.select("file_id", *keys, F.col("strength").alias("__s"), F.col("description").alias("__d")).join(old.select(*keys, "strength", "description", F.lit(1).alias("__o")), keys, "left")
    same = F.col("__s").eqNullSafe(F.col("strength")) & F.col("__d").eqNullSafe(F.col("description"))
    decision = F.when(F.col("file_id") != F.col("source_file_id"), "RELATION_SOURCE_MISMATCH").when(F.col("__o").isNull(), "insert").when(~same, "update").otherwise("none")
    return both.select("file_id", *keys, decision.alias("decision"))


def transitions(table: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """States of ``table(key, status)`` after the requests ``asked(key, status)``: the outcomes, one for each request, and the table.

    changed; already, where the state is the one asked for; not_found. Of several requests for one key the largest state counts.
    """
    want = asked.groupBy(key).agg(F.max("status").alias("__to"))
    out = want.join(table.select(key, F.col("status")), key, "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == F.col("__to"), "already").otherwise("changed")
    moved = table.join(want, key, "left").withColumn("status", F.coalesce("__to", "status")).select(table.columns)
    return out.select(key, F.col("__to").alias("status"), outcome.alias("outcome")), moved


def register(banks: DataFrame, asked: DataFrame) -> DataFrame:
    """``(bank, description, status, outcome)``: all banks after the requests ``asked(bank, description)``.

    A bank that is there gets the request's description (outcome exists), a new one is active (registered); a null
    description keeps the old one. Banks that were not asked for have a null outcome; of repeated requests the largest description counts.
    """
    want = asked.groupBy("bank").agg(F.max("description").alias("__d"), F.lit(True).alias("__asked"))
    both = banks.select("bank", "description", "status", F.lit(True).alias("__there")).join(want, "bank", "full_outer")
    outcome = F.when(F.col("__asked").isNull(), F.lit(None)).when(F.col("__there").isNull(), "registered").otherwise("exists")
    return both.select("bank", F.coalesce("__d", "description").alias("description"), F.coalesce("status", F.lit("active")).alias("status"), outcome.alias("outcome"))


def update_files(files: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``updates(id, ...)`` of some fields of files: ``(id, outcome)`` and the files after.

    FILE_NOT_FOUND, FILE_DELETED (a tombstone takes no update), updated, or none where nothing differs; null fields keep
    what is there. Of several updates of one file the largest value of each field counts.
    """
    fields = [c for c in updates.columns if c != "id"]
    want = updates.groupBy("id").agg(*[F.max(c).alias(c) for c in fields])
    renamed = want.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    both = renamed.join(files.select("id", "status", *fields, F.lit(True).alias("__there")), "id", "left")
    differs = F.lit(False)
    for c in fields:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    outcome = F.when(F.col("__there").isNull(), "FILE_NOT_FOUND").when(F.col("status") == "deleted", "FILE_DELETED").when(differs, "updated").otherwise("none")
    out = both.select("id", outcome.alias("outcome"))
    return out, project.patch(files, want.join(out.filter("outcome = 'updated'"), "id", "left_semi"), ["id"])


def delete_files(tables: dict[str, DataFrame], asked: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``asked(file_id)`` deleted: ``(file_id, outcome)``, FILE_NOT_FOUND, FILE_ALREADY_DELETED or deleted, and the tables after."""
    want = asked.select("file_id").distinct()
    both = want.join(tables["files"].select(F.col("id").alias("file_id"), "status"), "file_id", "left")
    outcome = F.when(F.col("status").isNull(), "FILE_NOT_FOUND").when(F.col("status") == "deleted", "FILE_ALREADY_DELETED").otherwise("deleted")
    out = both.select("file_id", outcome.alias("outcome"))
    return out, project.delete_files(tables, out.filter("outcome = 'deleted'"))


def bank_counts(banks: DataFrame, steps: DataFrame, width: int = project.PIECE) -> DataFrame:
    """``(bank, memory_count, rejected)`` after ``steps(bank, seq, kind)``, remember or forget, in order of ``seq``.

    Remembering adds one and is rejected where ``banks(bank, status, memory_count)`` is not active; forgetting takes one
    and stops at zero. Steps of banks that are not there, and steps without a number, are left out. A run of steps is the function x → max(x + sum, low),
    and two runs in a row are one again, so pieces of ``width`` numbers are summed up apart and then in order.
    """
    known = steps.filter("seq is not null").join(banks.select("bank", "status", F.col("memory_count").alias("c0")), "bank").withColumn("piece", F.floor(F.col("seq") / width))
    rejected = (F.col("kind") == "remember") & ~F.coalesce(F.col("status") == "active", F.lit(False))
    step = F.when(rejected, 0).when(F.col("kind") == "remember", 1).when(F.col("kind") == "forget", -1).otherwise(0)
    known = known.select("bank", "piece", "seq", "c0", step.alias("d"), rejected.cast("long").alias("no"))
    run = Window.partitionBy("bank", "piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the lowest running sum says from where the count, once at zero, climbs again
    pieces = known.withColumn("upto", F.sum("d").over(run)).groupBy("bank", "piece").agg(F.sum("d").alias("sum"), F.min("upto").alias("least"), F.sum("no").alias("no"))
    upto = Window.partitionBy("bank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    total = pieces.groupBy("bank").agg(F.sum("sum").alias("sum"), F.min(F.col("before") + F.col("least")).alias("least"), F.sum("no").alias("rejected"))
    out = banks.select("bank", F.col("memory_count").alias("c0")).join(total, "bank", "left")
    count = F.greatest(F.col("c0") + F.col("sum"), F.col("sum") - F.col("least"))
    return out.select("bank", F.coalesce(count, F.col("c0")).cast("long").alias("memory_count"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def converged(relations: DataFrame) -> DataFrame:
    """``relations`` with one row for each pair and type under its canonical id: the row that has it, else the one of the smallest id."""
    own = text.relation_id(F.col("source_file_id"), F.col("target_file_id"), F.col("relation_type"))
    rest = [c for c in relations.columns if c not in ("id", *project.KEYS["file_relations"])]
    first = F.min_by(F.struct(*rest), F.struct(F.col("id") != own, F.col("id"))).alias("__r")
    out = relations.groupBy(*project.KEYS["file_relations"]).agg(first).select(*project.KEYS["file_relations"], "__r.*")
    return out.withColumn("id", own).select(relations.columns)


def tracked(tracker: DataFrame, hashes: DataFrame, gone: DataFrame) -> DataFrame:
    """``tracker(path, ...)`` after its rows got what ``hashes(path, ...)`` knows of them and the paths of ``gone(path)`` went; absent paths do nothing."""
    return project.without(project.patch(tracker, hashes, ["path"]), gone.distinct(), ["path"])
