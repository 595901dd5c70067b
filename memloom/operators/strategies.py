"""Whole files to the chunks of their source type: frontmatter first, then the body, each with metadata, edges and tags.

The parts of a file are put together and numbered within its row. Edges and a session's fields are found by the joins of
``links`` and attached by path, one row for each file; contents take part in no join. What the joins of notes need, links
and frontmatter, is read from the contents once and written.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import classify, score, text
from memloom.functions.batches import bounded
from memloom.operators import chunk, links
from memloom.sources.shared import new_folder, written

#: The keys of a note that have a field of their own, by kind of note, and a session's.
NOTE_KEYS = {
    "obsidian": {"aliases": "aliases", "tags": "tags", "created": "created", "modified": "modified", "source": "source", "status": "status", "type": "type", "base": "base"},
    "vault": {"tags": "tags", "created": "createdAt", "modified": "updatedAt", "status": "status", "type": "type"},
}
NOTE_FIELDS = ["aliases", "tags", "created", "modified", "source", "status", "type", "base"]
SESSION_FIELDS = {"id": "sessionId", "createdAt": "createdAt", "status": "status", "phase": "phase", "nextAgent": "nextAgent"}
HEAD_IMPORTANCE, TAG_LIMIT = 0.9, 20
FIELDS = "struct<fields:map<string,string>,tags:array<string>,see_also:array<string>,is_index:boolean>"
EDGES = "array<struct<target_path:string,relation_type:string,strength:double>>"

#: Lines ``key: value`` of letters, digits and few signs.
_PLAIN = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_-]*: [A-Za-z0-9_ ./,'\[\]+-]*(?:\n|\Z))*")


@functools.lru_cache(maxsize=4096)
def _line(line: str) -> dict | None:
    """The entry a line of its own holds; null where it needs others or is no entry."""
    import yaml

    try:
        value = yaml.load(line, getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506
    except (yaml.YAMLError, ValueError):
        return None
    return value if isinstance(value, dict) else None


def loaded(front: str | None) -> dict:
    """The mapping a frontmatter block holds; empty where it is no YAML or no mapping."""
    import yaml

    # plain lines that each stand alone say together what they say one by one, and most repeat from note to note
    if front and _PLAIN.fullmatch(front):
        entries = [_line(line) for line in front.split("\n") if line]
        if None not in entries:
            return {k: v for entry in entries for k, v in entry.items()}
    try:
        value = yaml.load(front, yaml.SafeLoader) if front else None  # noqa: S506
    except (yaml.YAMLError, ValueError):
        value = None
    return value if isinstance(value, dict) else {}


def moment(value: object) -> str | None:
    """A date or time as ISO text in UTC with milliseconds; null for anything else."""
    if not isinstance(value, datetime.date):
        return None
    at = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
    if at.tzinfo is not None:
        at = at.astimezone(datetime.UTC)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=lambda x: moment(x) or str(x))


def strings(value: object) -> list[str]:
    listed = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return [x for x in listed if isinstance(x, str)]


def note_fields(front: Column, kind: str) -> Column:
    """What a note's frontmatter says, as FIELDS: its eight fields and ``note.properties.*``, its tags, its ``see_also``, whether it is an index.

    Text values count as they stand, others as JSON; a vault's dates become ISO text. A null block gives nulls.
    """
    keys = NOTE_KEYS[kind]
    typed = {k.lower() for k in keys.values()}

    def one(block: str | None) -> tuple | None:
        if block is None:
            return None
        record = loaded(block)
        fields = {}
        for name in NOTE_FIELDS:
            value = record.get(keys.get(name, ""))
            if name in ("aliases", "tags"):
                fields[f"note.{name}"] = compact(strings(value))
            else:
                dated = moment(value) if kind == "vault" and name in ("created", "modified") else None
                fields[f"note.{name}"] = value if isinstance(value, str) else dated or ""
        for key, value in record.items():
            if str(key).lower() not in typed:
                fields[f"note.properties.{str(key).lower()}"] = value if isinstance(value, str) else compact(value)
        also = record.get("see_also")
        return fields, strings(record.get("tags")), [x for x in strings(also) if isinstance(also, list) or x.strip()], record.get("type") == "index"

    bounded()

    @F.pandas_udf(FIELDS)
    def udf(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) or (None, None, None, None) for b in blocks], columns=["fields", "tags", "see_also", "is_index"])

    return udf.asNondeterministic()(front)


def session_fields(front: Column) -> Column:
    """The five ``session.*`` fields of a session's frontmatter; what is no text is empty."""

    bounded()

    @F.pandas_udf("map<string,string>")
    def udf(blocks: pd.Series) -> pd.Series:
        records = [loaded(b) for b in blocks]
        return pd.Series([{f"session.{k}": r.get(v) if isinstance(r.get(v), str) else "" for k, v in SESSION_FIELDS.items()} for r in records], dtype=object)

    return udf(front)


def lines(body: Column, path: Column) -> Column:
    """A splitter: each line that is not blank."""
    return F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: x.rlike(chunk.NOT_BLANK))


def by_chunker(body: Column, path: Column) -> Column:
    """The splitter of a path's chunker, with the longest chunk of its role."""
    return chunk.split_chunks(body, classify.chunker(path), classify.max_chars(classify.file_role(path)))


def listed(edges: DataFrame) -> DataFrame:
    """``(path, edges)``: each file's edges as one array, by kind and target."""
    one = F.struct("relation_type", "target_path", "strength")
    rows = edges.groupBy(F.col("source_path").alias("path")).agg(F.array_sort(F.collect_set(one)).alias("e"))
    return rows.select("path", F.transform("e", lambda x: F.struct(x.target_path.alias("target_path"), x.relation_type.alias("relation_type"), x.strength.alias("strength"))).alias("edges"))


def composed(files: DataFrame, head_tags: list[str], limit: int | None) -> DataFrame:
    """``files(bank, path, file_hash, front, parts, metadata, edges, note_tags)`` → chunk rows, densely numbered, with the total on each."""
    none = F.array().cast("array<string>")
    head = F.when(F.col("front").isNotNull(), F.array(F.concat(F.lit("---\n"), F.col("front"), F.lit("\n---")))).otherwise(none)
    held = files.withColumn("__c", F.concat(head, "parts"))
    rows = held.select("bank", "path", "file_hash", "metadata", "edges", "note_tags", F.col("front").isNotNull().alias("__f"), F.size("__c").alias("total_chunks"), F.posexplode("__c").alias("chunk_index", "chunk"))
    is_head = F.col("__f") & (F.col("chunk_index") == 0)
    ext = F.regexp_replace(classify.extension(F.col("path")), "^[.]", "")
    own = text.assemble_tags(ext, F.col("bank"), F.col("chunk"), F.lit(None).cast("string"))
    own = F.when(is_head, F.array(*[F.lit(t) for t in head_tags])).otherwise(own)
    heading = F.regexp_extract("chunk", r"^(#{1,6} [^\n]*)", 1)
    header = F.when(is_head, "Frontmatter").when(heading != "", heading).otherwise(F.col("path"))
    role = F.when(is_head, "docs").otherwise(classify.file_role(F.col("path")))
    return rows.select(
        "bank", "path", role.alias("file_role"), "file_hash", "chunk_index", "total_chunks", "chunk", header.alias("section_header"), text.chunk_hash(F.col("chunk")).alias("chunk_hash"),
        F.when(is_head, HEAD_IMPORTANCE).otherwise(score.importance(role, F.col("chunk"), header)).alias("importance"), text.merged_tags(own, F.col("note_tags"), limit).alias("tags"), "metadata", "edges",
    )


def joined_json(name: str, values: Column) -> Column:
    """A map of one entry, ``values`` as JSON; empty without values."""
    return F.when(F.size(values) > 0, F.create_map(F.lit(name), F.to_json(values))).otherwise(F.create_map().cast("map<string,string>"))


def _notes(notes: DataFrame, kind: str, split: Callable[[Column, Column], Column]) -> DataFrame:
    front, body = text.frontmatter(F.col("content")), text.body(F.col("content"))
    cut = notes.select("root", "bank", "path", F.sha2("content", 256).alias("file_hash"), front.alias("front"), body.alias("body"))
    shown = text.clean_wikilinks(F.col("body")) if kind == "vault" else F.col("body")
    # both Python columns in one step, so that a task has one worker
    held = cut.select("root", "bank", "path", "file_hash", "front", split(shown, F.col("path")).alias("parts"), text.wikilinks(F.col("body")).alias("links"), note_fields(F.col("front"), kind).alias("n"))
    if kind == "vault":
        held = held.filter(~classify.is_index_file(F.col("path"), F.when(F.col("n.is_index"), "index")))
    return held


def _facts(notes: DataFrame, once: bool) -> tuple[DataFrame, DataFrame]:
    """``(root, path, front)`` of the notes and ``(root, path, link)`` of their distinct links; ``once``: from one written table without contents."""
    front, found = text.frontmatter(F.col("content")), text.wikilinks(text.body(F.col("content")))
    facts = notes.select("root", "path", front.alias("front"), found.alias("links"))
    facts = written(facts, new_folder(notes.sparkSession, "notes")) if once else facts
    return facts.select("root", "path", "front"), facts.select("root", "path", F.explode("links").alias("link"))


def obsidian_chunks(notes: DataFrame, catalogue: DataFrame, split: Callable[[Column, Column], Column] = by_chunker, once: bool = True) -> DataFrame:
    """``notes(root, bank, path, content)`` as chunks with ``note.*`` metadata and tags; notes with links also carry these and their backlink edges."""
    _, named = _facts(notes, once)
    held = _notes(notes, "obsidian", split).join(listed(links.backlinks_of(named, catalogue)), "path", "left")
    empty = F.create_map().cast("map<string,string>")
    held = held.withColumn("metadata", F.map_concat(F.coalesce("n.fields", empty), joined_json("note.wikilinks", F.col("links"))))
    edges = F.when(F.size("links") > 0, F.coalesce("edges", F.array().cast(EDGES)))
    return composed(held.withColumn("edges", edges).withColumn("note_tags", F.col("n.tags")), ["frontmatter", "metadata", "obsidian-note"], None)


def vault_chunks(notes: DataFrame, catalogue: DataFrame, split: Callable[[Column, Column], Column] = by_chunker, once: bool = True) -> DataFrame:
    """``notes`` of a vault as chunks: index files left out, links cleaned, recommendation and backlink edges, at most TAG_LIMIT tags."""
    fronts, named = _facts(notes, once)
    also = fronts.select("root", "path", note_fields(F.col("front"), "vault").see_also.alias("also"))
    edges = links.see_also(also, catalogue, F.coalesce("also", F.array().cast("array<string>"))).unionByName(links.vault_links_of(named, catalogue))
    held = _notes(notes, "vault", split).join(listed(edges), "path", "left")
    empty = F.create_map().cast("map<string,string>")
    fields = F.map_filter(F.coalesce("n.fields", empty), lambda k, _: ~k.isin("note.wikilinks", "note.see_also"))
    more = F.map_concat(joined_json("note.wikilinks", F.col("links")), joined_json("note.see_also", F.coalesce("n.see_also", F.array().cast("array<string>"))))
    return composed(held.withColumn("metadata", F.map_concat(fields, more)).withColumn("note_tags", F.col("n.tags")), ["frontmatter", "metadata", "vault-node"], TAG_LIMIT)


def session_chunks(files: DataFrame, split: Callable[[Column, Column], Column] = by_chunker) -> DataFrame:
    """``files(bank, path, content)`` of sessions as chunks, each with its session's ``session.*`` fields and its companion and cross-reference edges."""
    rooted = links.session_roots(files)
    edges = links.companions(rooted).unionByName(links.references(rooted))
    of = files.filter(classify.basename(F.col("path")) == "session.md").select(classify.directory(F.col("path")).alias("session_root"), session_fields(text.frontmatter(F.col("content"))).alias("metadata"))
    front = text.frontmatter(F.col("content"))
    held = rooted.select("bank", "path", "session_root", F.sha2("content", 256).alias("file_hash"), F.when(front != "", front).alias("front"), split(text.body(F.col("content")), F.col("path")).alias("parts"))
    held = held.join(of, "session_root", "left").join(listed(edges), "path", "left")
    absent = F.create_map(*[F.lit(x) for k in SESSION_FIELDS for x in (f"session.{k}", "")])
    held = held.withColumn("metadata", F.coalesce("metadata", absent)).withColumn("edges", F.coalesce("edges", F.array().cast(EDGES)))
    return composed(held.withColumn("note_tags", F.array().cast("array<string>")), ["frontmatter", "metadata"], None)


def chunk_content(files: DataFrame, split: Callable[[Column, Column], Column] = by_chunker, once: bool = True) -> DataFrame:
    """``files(root, bank, path, source_type, content)`` → the chunks of each by the strategy of its source type, a column ``source_type`` more.

    Obsidian notes, vault notes and session files go to their strategies, with the files of their kind as catalogue; all others
    are chunked whole, without metadata and edges. Blank files give no row. ``once``: what the edges need is read from the contents
    once and written; without it nothing is written, and who leaves the edges out does not pay for them.
    """
    rows = files.withColumn("source_type", classify.source_type(F.col("source_type")))
    own = lambda kind: rows.filter(F.col("source_type") == kind).drop("source_type")
    notes, vault, sessions = own("obsidian"), own("vault"), own("agent-sessions")
    rest = rows.filter(~F.col("source_type").isin("obsidian", "vault", "agent-sessions"))
    empty = F.create_map().cast("map<string,string>")
    plain = rest.select("bank", "path", F.sha2("content", 256).alias("file_hash"), F.lit(None).cast("string").alias("front"), split(F.col("content"), F.col("path")).alias("parts"), empty.alias("metadata"), F.array().cast(EDGES).alias("edges"), F.array().cast("array<string>").alias("note_tags"))
    parts = [("obsidian", obsidian_chunks(notes, notes, split, once)), ("vault", vault_chunks(vault, vault, split, once)), ("agent-sessions", session_chunks(sessions.select("bank", "path", "content"), split)), ("unknown", composed(plain, [], None))]
    out = None
    for kind, df in parts:
        df = df.withColumn("source_type", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out
