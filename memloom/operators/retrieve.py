"""Questions to the store: recall, file search, enrichment, expansion, reconstruction, full text.

Contents are attached last, to the rows that an answer keeps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text
from memloom.operators.lifecycle import file_block
from memloom.sources.shared import few

BM25_K1, BM25_B = 1.2, 0.75


def shingled(rows: DataFrame, key: str, content: str, n: int) -> DataFrame:
    """``(key, gram)``: the distinct runs of ``n`` words of each row, as 64-bit hashes."""
    words = text.words(F.col(content))
    held = rows.select(key, words.alias("__w"))
    if n == 1:
        grams = F.col("__w")
    else:
        starts = F.sequence(F.lit(1), F.greatest(F.size("__w") - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("__w", i + (j - 1)) for j in range(n)]))
        grams = F.when(F.size("__w") >= n, grams).otherwise(F.array().cast("array<string>"))
    hashed = F.transform(grams, lambda g: F.xxhash64(g))
    return held.select(key, F.explode(F.array_distinct(hashed)).alias("gram"))


def small(rows: DataFrame, limit: int = 500_000) -> DataFrame:
    """``rows``, to be broadcast if they are at most ``limit``; more are left to the planner, and a shuffle join."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def recall(memories: DataFrame, queries: DataFrame, k: int = 5, n: int = 1) -> DataFrame:
    """``(query_id, rank, memory_id, score)``: the best ``k`` memories of each query, ties to the smaller id.

    The score is the share of the query's distinct runs of ``n`` words the memory holds.
    ``memories(memory_id, content)``, ``queries(query_id, query)``; a memory that repeats counts once. The query runs are
    broadcast below a checked number, so memory runs that no query has are dropped where they are read.
    """
    asked = shingled(queries, "query_id", "query", n)
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("size"))
    hits = shingled(memories, "memory_id", "content", n).join(small(asked), "gram").distinct().groupBy("query_id", "memory_id").agg(F.count("*").alias("hits"))
    scored = hits.join(small(sizes), "query_id").select("query_id", "memory_id", F.round(F.col("hits") / F.col("size"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "memory_id", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def recall_vectors(memories: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """``(memory_id, score)``: the best ``k`` of ``memories(memory_id, embedding)`` by cosine, to four places."""
    scored = memories.select("memory_id", F.round(cosine(F.col("embedding"), F.lit(query)), 4).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), "memory_id").limit(k)


def first_chunk(chunks: DataFrame) -> DataFrame:
    """One chunk for each memory: the smallest index, then the smallest file."""
    least = F.min_by(F.struct("file_id", "chunk_index", "start_line", "end_line", "section_header"), F.struct("chunk_index", "file_id"))
    return chunks.groupBy("memory_id").agg(least.alias("c")).select("memory_id", "c.*")


def located(found: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``found(memory_id, ...)`` with its first chunk and that chunk's file; nulls where it has none."""
    found = few(found)
    near = chunks.join(found.select("memory_id").distinct(), "memory_id", "left_semi")
    held = few(found.join(first_chunk(near), "memory_id", "left"))
    named = files.select(F.col("id").alias("file_id"), "path", "source_type", "file_role", "tags", "summary")
    named = named.join(held.select("file_id").distinct(), "file_id", "left_semi")
    return held.join(named, "file_id", "left")


def search_files(found: DataFrame, chunks: DataFrame, files: DataFrame, source_type: str | None = None, file_role: str | None = None, relations: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Recalled memories grouped by file: ``(kind, position, file_id, path, memory_ids, best_score)``.

    ``found(rank, memory_id, score)`` is already limited. Memories without a file, and those
    whose file does not fit a filter, stay as rows of their own, before the groups. With ``relations`` each row also has
    its file's ``k`` strongest edges, as ``relations``: array of (id, relation_type, strength, description), empty without a file.
    """
    rows = few(located(found, chunks, files)) if relations is not None else located(found, chunks, files)
    fits = F.col("path").isNotNull()
    if source_type is not None:
        fits = fits & (F.col("source_type") == source_type)
    if file_role is not None:
        fits = fits & F.coalesce(F.col("file_role") == file_role, F.lit(False))
    rows = rows.withColumn("__fits", F.coalesce(fits, F.lit(False)))
    own = lambda c: F.when(F.col("__fits"), F.col(c)).alias(c)
    alone = F.when(~F.col("__fits"), F.col("memory_id")).alias("__alone")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x.memory_id)
    groups = rows.groupBy(F.when(F.col("__fits"), "file").otherwise("memory").alias("kind"), own("file_id"), own("path"), alone)
    groups = groups.agg(F.min("rank").alias("__at"), ordered.alias("memory_ids"), F.max("score").alias("best_score"))
    position = F.row_number().over(Window.orderBy(F.desc("kind"), "__at"))  # at most the recall limit of rows
    out = groups.withColumn("position", position).select("kind", "position", "file_id", "path", "memory_ids", "best_score")
    if relations is None:
        return out
    edges = strongest(out.select("file_id").distinct(), relations, k)
    return out.join(listed_edges(edges), "file_id", "left").withColumn("relations", F.coalesce("relations", F.array().cast(EDGE_LIST)))


EDGE_LIST = "array<struct<id:string,relation_type:string,strength:double,description:string>>"


def _edges(files: DataFrame, relations: DataFrame) -> DataFrame:
    """What ``strongest`` gives, and ``total``, the number of a file's edges. One pass over the relations."""
    s, t = F.col("source_file_id"), F.col("target_file_id")
    end = lambda a, b: F.struct(a.alias("file_id"), b.alias("other_id"))
    ends = F.explode(F.when(s == t, F.array(end(s, t))).otherwise(F.array(end(s, t), end(t, s)))).alias("e")
    described = F.col("description") if "description" in relations.columns else F.lit(None).cast("string").alias("description")
    both = relations.select(ends, "id", "relation_type", "strength", described).select("e.*", "id", "relation_type", "strength", "description")
    both = both.join(files.select("file_id").distinct(), "file_id", "left_semi")
    own = Window.partitionBy("file_id")
    return both.withColumn("n", F.row_number().over(own.orderBy(F.desc("strength"), "id"))).withColumn("total", F.count("*").over(own))


def strongest(files: DataFrame, relations: DataFrame, k: int | None = None) -> DataFrame:
    """``(file_id, n, id, other_id, relation_type, strength, description)``: the edges at either end of each of ``files(file_id)``, strongest first.

    Of equal strength the smaller id comes first. Edges to one other file stay apart, and count each.
    """
    ranked = _edges(files, relations)
    ranked = ranked if k is None else ranked.filter(F.col("n") <= k)
    return ranked.select("file_id", "n", "id", "other_id", "relation_type", "strength", "description")


def listed_edges(edges: DataFrame) -> DataFrame:
    """``(file_id, relations)`` from edges that ``strongest`` limited."""
    block = F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "relation_type", "strength", "description"))), lambda x: F.struct(x.id.alias("id"), x.relation_type.alias("relation_type"), x.strength.alias("strength"), x.description.alias("description")))
    return edges.groupBy("file_id").agg(block.alias("relations"))


def related(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, n, other_id, path, summary, relation, description)``: the other ends of ``strongest`` edges, each once, by its first edge.

    A file is not its own relative, and ends that ``files`` lacks go.
    """
    first = edges.filter("other_id <> file_id").groupBy("file_id", "other_id").agg(F.min_by(F.struct("n", "relation_type", "description"), "n").alias("e"))
    named = files.select(F.col("id").alias("other_id"), "path", "summary")
    return first.join(named, "other_id").select("file_id", "e.n", "other_id", "path", "summary", F.col("e.relation_type").alias("relation"), "e.description")


def relation_counts(relations: DataFrame) -> DataFrame:
    """``(file_id, related_files_count)``: edges at either end of each file."""
    ends = relations.select(F.explode(F.array("source_file_id", "target_file_id")).alias("file_id"))
    return ends.groupBy("file_id").agg(F.count("*").alias("related_files_count"))


def summary_chain(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(file_id, chain)``: the file's summary (a mechanical one if it has none), then its chunks' parent summaries, each once."""
    parents = chunks.filter("parent_unit_summary is not null").groupBy("file_id", "parent_unit_summary").agg(F.min("chunk_index").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "parent_unit_summary"))), lambda x: x.parent_unit_summary)
    parents = parents.groupBy("file_id").agg(listed.alias("parents"))
    none = F.array().cast("array<string>")
    head = F.when(F.length("summary") > 0, F.col("summary")).otherwise(text.mechanical_summary(F.col("path"), none, F.col("tags")))
    named = files.select(F.col("id").alias("file_id"), head.alias("head"))
    return named.join(parents, "file_id", "left").select("file_id", F.concat(F.array("head"), F.coalesce("parents", none)).alias("chain"))


def enrich(found: DataFrame, tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """``found(memory_id, ...)``, a few rows, each with its file's block ``file_enrichment``: null where it has no file.

    The block: ``file`` (its row), ``relations`` (the ``k`` strongest edges), ``related_files`` (their other ends), ``related_files_count``
    (all edges), ``summary_chain``, ``traversal`` (file id and relation ids), ``source_type_enrichment`` (the file's metadata) and ``chunk_hash``, the
    memory's own.
    """
    chunks, files, relations = tables["file_chunks"], tables["files"], tables["file_relations"]
    found = few(found)
    near = chunks.join(found.select("memory_id").distinct(), "memory_id", "left_semi")
    least = F.min_by(F.struct("file_id", F.col("content_hash").alias("chunk_hash")), F.struct("chunk_index", "file_id"))
    rows = few(found.join(near.groupBy("memory_id").agg(least.alias("c")).select("memory_id", "c.*"), "memory_id", "left"))
    own = rows.filter("file_id is not null").select("file_id").distinct()
    mine = few(files.join(own.withColumnRenamed("file_id", "id"), "id", "left_semi"))
    every = few(_edges(own, relations))
    count = every.filter("n = 1").select("file_id", F.col("total").alias("related_files_count"))
    edges = every.filter(F.col("n") <= k).drop("total")  # at most k for each row found
    ends = edges.select(F.col("other_id").alias("id")).distinct()
    others = related(edges, files.join(ends, "id", "left_semi"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("other_id").alias("id"), "path", "summary", "relation", "description"))), lambda x: F.struct(x.id.alias("id"), x.path.alias("path"), x.summary.alias("summary"), x.relation.alias("relation"), x.description.alias("description")))
    others = others.groupBy("file_id").agg(listed.alias("related_files"))
    chains = summary_chain(mine, chunks.join(own, "file_id", "left_semi"))
    block = mine.select(F.col("id").alias("file_id"), file_block(mine).alias("file"), F.col("metadata") if "metadata" in mine.columns else F.lit(None).cast("map<string,string>").alias("metadata"))
    for more in (listed_edges(edges), others, count, chains):
        block = block.join(more, "file_id", "left")
    none = F.array().cast(EDGE_LIST)
    block = block.select(
        "file_id", "file", F.coalesce("relations", none).alias("relations"),
        F.coalesce("related_files", F.array().cast("array<struct<id:string,path:string,summary:string,relation:string,description:string>>")).alias("related_files"),
        F.coalesce("related_files_count", F.lit(0)).alias("related_files_count"), F.col("chain").alias("summary_chain"),
        F.struct("file_id", F.transform(F.coalesce("relations", none), lambda r: r.id).alias("relation_ids")).alias("traversal"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("source_type_enrichment"),
    )
    names = [c for c in block.columns if c != "file_id"]
    out = rows.join(block, "file_id", "left")
    whole = F.when(F.col("file").isNotNull(), F.struct(*names, "chunk_hash"))
    return out.select(*found.columns, whole.alias("file_enrichment"))


def with_contents(chunks: DataFrame, memories: DataFrame) -> DataFrame:
    """``chunks`` with ``content``; empty contents count as missing."""
    texts = memories.select("memory_id", "content").filter("content <> ''")
    return chunks.join(texts, "memory_id", "left")


def fetch_whole(chunks: DataFrame, memories: DataFrame) -> DataFrame:
    """``(file_id, content, n_chunks, status, missing)``: each file's chunks joined by line ends, with a mark for each gap."""
    gap = F.format_string("<< missing chunk %s (index=%d, lines=%d-%d) >>", "memory_id", "chunk_index", "start_line", "end_line")
    rows = with_contents(chunks, memories)
    part = F.struct("chunk_index", "start_line", "memory_id", F.coalesce("content", gap).alias("part"), F.col("content").isNull().alias("gone"))
    whole = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    lost = F.transform(F.filter("p", lambda x: x.gone), lambda x: x.memory_id)
    return whole.select(
        "file_id", F.array_join(F.transform("p", lambda x: x.part), "\n").alias("content"), F.size("p").alias("n_chunks"),
        F.when(F.size(lost) > 0, "partial").otherwise("complete").alias("status"), lost.alias("missing"),
    )


def fetch_neighbours(chunks: DataFrame, centres: DataFrame, adjacent: int = 1) -> DataFrame:
    """``chunks`` around ``centres(file_id, centre)``: the chunk with that index and ``adjacent`` places to either side.

    Places count positions in (index, line) order, not index values. A centre that is not there gives no row: see ``missing_centres``.
    """
    if not 0 <= adjacent <= 5:
        raise ValueError("adjacent must be between 0 and 5")
    order = Window.partitionBy("file_id").orderBy("chunk_index", "start_line", "memory_id")
    near = chunks.join(centres, "file_id").withColumn("position", F.row_number().over(order))
    at = F.min(F.when(F.col("chunk_index") == F.col("centre"), F.col("position"))).over(Window.partitionBy("file_id"))
    return near.withColumn("__at", at).filter(F.abs(F.col("position") - F.col("__at")) <= adjacent).drop("__at")


def missing_centres(chunks: DataFrame, centres: DataFrame) -> DataFrame:
    """``(file_id, centre, available)``: the centres that their file has no chunk for, with the indexes it has, in order."""
    lost = centres.join(chunks.select("file_id", F.col("chunk_index").alias("centre")).distinct(), ["file_id", "centre"], "left_anti")
    held = chunks.join(lost.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_set("chunk_index")).alias("available"))
    return lost.join(held, "file_id", "left").select("file_id", "centre", F.coalesce("available", F.array().cast("array<int>")).alias("available"))


def with_file(fetched: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``fetched(file_id, ...)`` with its file's row ``file`` and ``total_chunks``, as the metadata of a fetch."""
    counts = chunks.groupBy("file_id").agg(F.count("*").cast("int").alias("total_chunks"))
    named = files.select(F.col("id").alias("file_id"), file_block(files.drop("total_chunks")).dropFields("total_chunks").alias("file"))
    return fetched.join(named, "file_id", "left").join(counts, "file_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))


def expand(files: DataFrame, tables: dict[str, DataFrame], memories: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Outgoing relations of ``files(file_id)``, one for each target: the target's block, and its composed content.

    Without ``memories`` the content is the summary alone, and no text is read.
    """
    edges = tables["file_relations"].join(files.select(F.col("file_id").alias("source_file_id")).distinct(), "source_file_id", "left_semi")
    if kinds is not None:
        edges = edges.filter(F.col("relation_type").isin(kinds))
    one = edges.groupBy("source_file_id", "target_file_id").agg(F.min_by(F.struct("relation_type", "strength"), "id").alias("r"))
    named = tables["files"].select(F.col("id").alias("target_file_id"), "path", "summary")
    out = one.select("source_file_id", "target_file_id", "r.*").join(named, "target_file_id")
    if memories is None:
        return out.withColumn("content", F.coalesce("summary", F.lit(""))).withColumn("n_chunks", F.lit(0)).drop("summary")
    near = tables["file_chunks"].join(out.select(F.col("target_file_id").alias("file_id")).distinct(), "file_id", "left_semi")
    composed = compose(near, memories).withColumnRenamed("file_id", "target_file_id")
    head = F.when(F.length("summary") > 0, F.col("summary"))
    whole = out.join(composed, "target_file_id", "left")
    body = F.when(F.length("content") > 0, F.col("content"))
    return whole.withColumn("content", F.concat_ws("\n\n", head, body)).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).drop("summary")


def compose(chunks: DataFrame, memories: DataFrame) -> DataFrame:
    """``(file_id, content, n_chunks)``: the contents there are, in order, joined by line ends."""
    rows = with_contents(chunks, memories)
    known = F.collect_list(F.when(F.col("content").isNotNull(), F.struct("chunk_index", "memory_id", "content")))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(known), lambda x: x.content), "\n").alias("content"), F.count("*").cast("int").alias("n_chunks"))


def full_text(files: DataFrame, query: str) -> DataFrame:
    """``files(id, path, keywords, tags)`` that hold ``query`` (three characters or more) in their path, keywords or tags, in any case."""
    document = text.file_document(F.col("path"), F.col("keywords"), F.col("tags"))
    return files.filter(document.contains(query.lower()) if len(query) >= 3 else F.lit(False))


def full_text_ranked(files: DataFrame, query: str) -> DataFrame:
    """``(id, score)`` of the files that hold ``query``, by BM25 over the query's trigrams.

    Each file's text is put together once a pass, and the query's trigrams are counted in it. Two passes: the
    number of files, their mean length and the trigrams' frequencies; then the scores.
    """
    wanted = query.lower()
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    times = lambda d, g: F.regexp_count(d, F.lit(f"(?={re.escape(g)})"))
    facts = lambda d: F.struct(F.greatest(F.length(d) - 2, F.lit(0)).alias("len"), d.contains(wanted).alias("fits"), F.array(*[times(d, g) for g in grams]).alias("t"))
    document = text.file_document(F.col("path"), F.col("keywords"), F.col("tags"))
    held = files.select("id", F.explode(F.array(document)).alias("d"))  # a generator, so that no later column puts the text together again
    counted = held.select("id", facts(F.col("d")).alias("f")).select("id", "f.*")
    if not grams:
        return counted.filter("false").select("id", F.lit(0.0).alias("score"))
    total = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col("t")[i] > 0).alias(f"d{i}") for i in range(len(grams))]).first()
    score = F.lit(0.0)
    for i in range(len(grams)):
        d = total[f"d{i}"] or 0
        idf = F.log(F.lit((total["n"] - d + 0.5) / (d + 0.5) + 1))
        tf = F.col("t")[i]
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.lit(max(total["mean"] or 1.0, 1.0))))
    return counted.filter("fits").select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id")


def bank_list(banks: DataFrame, memories: DataFrame) -> DataFrame:
    """``(bank, description, n_memories)``: registered and active banks, with 0 where there is no memory."""
    counts = memories.groupBy("bank").agg(F.count("*").alias("n_memories"))
    return banks.join(counts, "bank", "full_outer").select("bank", "description", F.coalesce("n_memories", F.lit(0)).alias("n_memories"))


def bank_stats(memories: DataFrame) -> DataFrame:
    """``(bank, total, working, episodic, mean_importance)`` of ``memories(bank, scope, importance)``."""
    return memories.groupBy("bank").agg(
        F.count("*").alias("total"), F.count_if(F.col("scope") == "working").alias("working"), F.count_if(F.col("scope") == "episodic").alias("episodic"), F.round(F.avg("importance"), 6).alias("mean_importance")
    )
