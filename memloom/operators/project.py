"""The projection of remembered chunks: tables of files, chunks and typed relations.

Remembered rows carry ``bank, path, seq, memory_id, chunk_index, start_line, end_line,
section_header, chunk_hash, file_hash, source_type, file_role, language, summary, extra, tags,
parent_unit, edges``; ``seq`` is their order. Contents stay in the table of memories: no
shuffle here carries a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text

KEYS = {"files": ["id"], "file_chunks": ["file_id", "memory_id"], "file_relations": ["source_file_id", "target_file_id", "relation_type"]}


#: Numbers of ``seq`` that one piece of a file spans, and so its rows at most.
PIECE = 1 << 20


def deduplicated(rows: DataFrame) -> DataFrame:
    """One memory for each content of a bank: ``(bank, memory_id, chunk_hash, first_seq, repeats)``.

    The id is a function of the content, so equal contents are counted before the shuffle.
    """
    keyed = rows.select("bank", "chunk_hash", "seq", text.memory_id(F.col("bank"), F.col("chunk_hash")).alias("memory_id"))
    return keyed.groupBy("bank", "memory_id", "chunk_hash").agg(F.min("seq").alias("first_seq"), F.count("*").alias("repeats"))


def epochs(rows: DataFrame, null_hash_resets: bool = True, width: int = PIECE) -> DataFrame:
    """``rows`` with ``epoch``: it grows where a file's hash differs from the last one known before.

    A null hash keeps the last known one; whether it also starts an epoch is ``null_hash_resets``. ``seq`` is unique
    within a file. A file's rows are cut into pieces of ``width`` numbers of ``seq``, so that no task holds a whole long
    file: windows run inside pieces, each piece is summed up in one row (its nulls before the first hash, that hash,
    the changes after it, its last hash), a scan over these rows says what each piece begins with, and its rows add that.
    """
    piece = F.floor(F.col("seq") / width).alias("__piece")
    inside = Window.partitionBy("file_id", "__piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file_id", "__piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("file_hash", ignorenulls=True).over(before)
    local = rows.select("*", piece).withColumn("__k", known)
    lead = F.col("__k").isNull() & F.col("file_hash").isNull()
    differs = ~F.col("file_hash").eqNullSafe(F.col("__k")) if null_hash_resets else F.coalesce(F.col("file_hash") != F.col("__k"), F.lit(False))
    local = local.withColumn("__r", (F.col("__k").isNotNull() & differs).cast("int")).withColumn("__l", (lead & F.lit(null_hash_resets)).cast("int"))
    heads = local.groupBy("file_id", "__piece").agg(
        F.sum("__l").alias("leads"), F.sum("__r").alias("changes"), F.min_by("file_hash", F.when(F.col("file_hash").isNotNull(), F.col("seq"))).alias("first"), F.max_by("file_hash", F.when(F.col("file_hash").isNotNull(), F.col("seq"))).alias("last")
    )
    order = Window.partitionBy("file_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("carry", F.last("last", ignorenulls=True).over(order))
    turned = (F.col("carry").isNotNull() & F.coalesce(F.col("first") != F.col("carry"), F.lit(False))).cast("int")
    heads = heads.withColumn("turned", turned).withColumn("all", F.col("changes") + F.col("turned") + F.when(F.col("carry").isNotNull(), F.col("leads")).otherwise(0))
    heads = heads.select("file_id", "__piece", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("__from"), F.col("carry").isNotNull().alias("__c"), F.col("turned").alias("__t"))
    met = F.last("file_hash", ignorenulls=True).over(inside).isNotNull()
    local = local.withColumn("__m", met.cast("int")).withColumn("__rs", F.sum("__r").over(inside)).withColumn("__ls", F.sum("__l").over(inside))
    out = local.join(heads, ["file_id", "__piece"])
    epoch = F.col("__from") + F.col("__rs") + F.when(F.col("__c"), F.col("__ls") + F.col("__t") * F.col("__m")).otherwise(0)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], epoch.alias("epoch"))


def resets(rows: DataFrame) -> DataFrame:
    """``(file_id, since)`` of the files that changed: the ``seq`` their newest epoch begins with. Epochs never fall as ``seq`` grows."""
    known = epochs(rows.select("file_id", "seq", "file_hash"))
    since = known.groupBy("file_id").agg(F.max("epoch").alias("e"), F.max_by("seq", F.struct(F.col("epoch"), -F.col("seq"))).alias("since"))
    return since.filter("e > 0").select("file_id", "since")


def last_epoch(rows: DataFrame, null_hash_resets: bool = True) -> DataFrame:
    """The rows since each file last changed, with ``last_epoch`` the file's newest."""
    known = epochs(rows, null_hash_resets)
    return known.withColumn("last_epoch", F.max("epoch").over(Window.partitionBy("file_id"))).filter("epoch = last_epoch")


def newest(order: Column, *names: str) -> list[Column]:
    return [F.max_by(n, order).alias(n) for n in names]


def newest_known(column: str, order: Column) -> Column:
    """The last value of a group that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)


def chunks_of(rows: DataFrame) -> DataFrame:
    """``file_chunks``: the newest row of each memory of a file, in the file's last epoch.

    Where an index stays the same, a null keeps the value that an older row of that index had.
    """
    # whole rows take no part in the epochs: they are told by where a file's last one begins
    current = rows.join(resets(rows), "file_id", "left").filter("seq >= coalesce(since, seq)")
    order = F.col("seq")
    at = Window.partitionBy("file_id", "memory_id")
    same = current.withColumn("__i", F.max_by("chunk_index", order).over(at)).filter("chunk_index = __i").drop("__i")
    same = same.withColumn("parent_unit_ref", F.col("parent_unit.ref")).withColumn("parent_unit_summary", F.col("parent_unit.summary"))
    kept = [newest_known(c, order) for c in ("start_line", "end_line", "section_header", "chunk_hash", "parent_unit_ref", "parent_unit_summary")]
    out = same.groupBy("file_id", "memory_id").agg(*newest(order, "chunk_index"), *kept)
    return out.select(
        text.chunk_id(F.col("file_id"), F.col("memory_id")).alias("id"), "file_id", "memory_id", "chunk_index",
        F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"),
        "section_header", F.col("chunk_hash").alias("content_hash"), F.lit("text").alias("content_type"), F.lit(False).alias("is_partial"),
        "parent_unit_ref", "parent_unit_summary",
    )


def relations_of(rows: DataFrame) -> DataFrame:
    """``file_relations``: the newest edge of each pair and type, declared since both its files last changed; none to itself."""
    order = F.col("seq")
    changed = resets(rows)
    edges = rows.select("bank", "file_id", "seq", F.explode("edges").alias("edge"))
    edges = edges.select(F.col("file_id").alias("source_file_id"), text.file_id(F.col("bank"), F.col("edge.target_path")).alias("target_file_id"), "edge.relation_type", "edge.strength", "edge.description", "seq")
    edges = edges.filter("source_file_id <> target_file_id")
    # the row that starts an epoch declares its edges after the older ones have gone
    own = changed.select(F.col("file_id").alias("source_file_id"), F.col("since").alias("own_since"))
    other = changed.select(F.col("file_id").alias("target_file_id"), F.col("since").alias("other_since"))
    live = edges.join(own, "source_file_id", "left").join(other, "target_file_id", "left")
    live = live.filter("seq >= coalesce(own_since, seq) and seq >= coalesce(other_since, seq)")
    out = live.groupBy("source_file_id", "target_file_id", "relation_type").agg(*newest(order, "strength", "description"))
    return out.select(
        text.relation_id(F.col("source_file_id"), F.col("target_file_id"), F.col("relation_type")).alias("id"),
        "source_file_id", "target_file_id", "relation_type", "strength", F.lit("unidirectional").alias("direction"), "description",
    )


def files_of(rows: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """``files``: of each attribute the last value known; tags in order without repeats; the number of projected chunks.

    Targets of edges that no row describes become pending files. The order of tags is
    the order of their first appearance.
    """
    order = F.col("seq")
    known = rows.withColumn("source_type", F.when(F.col("source_type") != "unknown", F.col("source_type")))
    attributes = [newest_known(c, order) for c in ("source_type", "file_role", "file_hash", "language", "summary")]
    base = known.groupBy("file_id", "bank", "path").agg(*attributes)
    tags = rows.select("file_id", "seq", F.posexplode("tags").alias("n", "tag")).groupBy("file_id", "tag").agg(F.min(F.struct("seq", "n")).alias("at"))
    tags = tags.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x.tag).alias("tags"))
    extra = rows.select("file_id", "seq", F.explode("extra").alias("key", "value")).groupBy("file_id", "key").agg(F.max_by("value", order).alias("value"))
    extra = extra.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    counts = file_chunks.groupBy("file_id").agg(F.count("*").cast("int").alias("total_chunks"))
    out = base.join(tags, "file_id", "left").join(extra, "file_id", "left").join(counts, "file_id", "left")
    out = out.select(
        F.col("file_id").alias("id"), "bank", "path", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "file_role", "file_hash", "language", "summary",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "metadata", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.lit("indexed").alias("status"),
    )
    return out.unionByName(stubs(rows, base.select("file_id")), allowMissingColumns=True)


def stubs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pending files for the targets of edges that are not among ``known(file_id)``."""
    targets = rows.select("bank", F.explode("edges.target_path").alias("path")).distinct().withColumn("file_id", text.file_id(F.col("bank"), F.col("path")))
    return targets.join(known, "file_id", "left_anti").select(
        F.col("file_id").alias("id"), "bank", "path", F.lit("unknown").alias("source_type"), F.array().cast("array<string>").alias("tags"), F.lit(0).alias("total_chunks"), F.lit("pending").alias("status")
    )


def materialize(rows: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a batch of remembered rows. The same batch again gives the same tables."""
    keyed = rows.withColumn("file_id", text.file_id(F.col("bank"), F.col("path")))
    chunks = chunks_of(keyed)
    return {"files": files_of(keyed, chunks), "file_chunks": chunks, "file_relations": relations_of(keyed)}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``change``: insert, delete, update or none, comparing the columns both tables have."""
    shared = [c for c in new.columns if c in old.columns and c not in keys]
    digest = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*shared)), 256).alias(name))
    both = digest(old, "__o").join(digest(new, "__n"), keys, "full_outer")
    kind = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").when(F.col("__o") != F.col("__n"), "update").otherwise("none")
    return both.select(*keys, kind.alias("change"))


def patch(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the values of ``updates`` that are not null; updates of absent rows do nothing."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in updates.columns if c not in keys])
    joined = table.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in renamed.columns else F.col(c) for c in table.columns])


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def touching(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Relations with either end among ``files(file_id)``: two equi joins, each relation once."""
    ends = files.select("file_id").distinct()
    source = relations.join(ends.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_semi")
    target = relations.join(ends.withColumnRenamed("file_id", "target_file_id"), "target_file_id", "left_semi")
    return source.unionByName(target).dropDuplicates(KEYS["file_relations"])


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tombstones: the rows of ``gone(file_id)`` get the status deleted, their chunks and relations go."""
    ends = gone.select("file_id").distinct()
    marked = tables["files"].join(ends.select(F.col("file_id").alias("id"), F.lit(True).alias("__gone")), "id", "left")
    files = marked.withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).drop("__gone")
    chunks = tables["file_chunks"].join(ends, "file_id", "left_anti")
    relations = tables["file_relations"]
    for side in ("source_file_id", "target_file_id"):
        relations = relations.join(ends.withColumnRenamed("file_id", side), side, "left_anti")
    return {"files": files, "file_chunks": chunks, "file_relations": relations.select(tables["file_relations"].columns)}


def forget(tables: dict[str, DataFrame], memories: DataFrame) -> dict[str, DataFrame]:
    """Remove ``memories(memory_id)``: their chunks go, and a file left without a chunk becomes a tombstone."""
    gone = memories.select("memory_id").distinct()
    chunks = tables["file_chunks"].join(gone, "memory_id", "left_anti").select(tables["file_chunks"].columns)
    touched = tables["file_chunks"].join(gone, "memory_id", "left_semi").select("file_id").distinct()
    empty = touched.join(chunks.select("file_id"), "file_id", "left_anti")
    out = delete_files(tables | {"file_chunks": chunks}, empty)
    counts = out["file_chunks"].groupBy("file_id").agg(F.count("*").cast("int").alias("total_chunks"))
    files = out["files"].drop("total_chunks").join(counts.withColumnRenamed("file_id", "id"), "id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
    return out | {"files": files.select(tables["files"].columns)}


def sync_members(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``action`` (add, remove, keep) that turn the member set ``old`` into ``new``."""
    both = old.select(*keys).distinct().withColumn("__o", F.lit(1)).join(new.select(*keys).distinct().withColumn("__n", F.lit(1)), keys, "full_outer")
    action = F.when(F.col("__o").isNull(), "add").when(F.col("__n").isNull(), "remove").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def consolidate(memories: DataFrame) -> DataFrame:
    """Working memories to episodic ones: one for each normalised content of a bank, with the largest importance.

    ``memories(bank, memory_id, content, importance)`` → ``(bank, content_key, memory_id, importance, merged)``.
    """
    key = F.sha2(text.normalized(F.col("content")), 256)
    keyed = memories.select("bank", key.alias("content_key"), "memory_id", "importance")
    return keyed.groupBy("bank", "content_key").agg(F.min("memory_id").alias("memory_id"), F.max("importance").alias("importance"), F.count("*").alias("merged"))
