"""The payload of one remembered chunk: JSON text to typed columns, never rejecting a row.

Wrong types and values out of range become null or their default, unknown text keys
go to ``extra``, old names stand in where the present ones are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.classify import known_role, source_type

#: Old names of keys.
OLD_NAMES = {
    "file_path": ["breadcrumb", "filePath"],
    "chunk_index": ["chunkIndex"],
    "total_chunks": ["totalChunks"],
    "section_header": ["sectionHeader"],
    "start_line": ["startLine"],
    "end_line": ["endLine"],
    "file_hash": ["hash", "fileHash"],
    "file_role": ["fileRole"],
}
#: Keys and relation types of the payload.
KNOWN = (
    "contract_version file_path chunk_index total_chunks section_header start_line end_line source_type file_role "
    "language file_hash chunk_hash summary parent_unit edges tags extra"
).split()
RELATION_TYPES = "parent_child sibling backlink folder_hierarchy cross_reference version override dependency recommendation".split()
EDGES = "array<struct<target_path:string,relation_type:string,strength:double,description:string>>"


def parse_edges(edges: Column) -> Column:
    """Typed edges of a JSON array; those without a target, of unknown type or of a strength outside 0 to 1 go."""
    parsed = F.from_json(edges, EDGES)
    filled = F.transform(
        parsed,
        lambda e: F.struct(
            e.target_path.alias("target_path"), e.relation_type.alias("relation_type"), F.coalesce(e.strength, F.lit(1.0)).alias("strength"), e.description.alias("description")
        ),
    )
    return F.filter(filled, lambda e: (F.length(F.trim(e.target_path)) > 0) & e.relation_type.isin(RELATION_TYPES) & e.strength.between(0, 1))


def parse(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with the columns of the payload; rows that name no file have a null ``file_path``."""
    keyed = rows.withColumn("__m", F.from_json(payload, "map<string,string>"))
    m = F.col("__m")

    def raw(key: str) -> Column:
        return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in [key, *OLD_NAMES.get(key, [])]])

    def count(key: str, least: int, default: int | None) -> Column:
        v = F.when(raw(key).rlike(r"^-?\d{1,9}$"), raw(key).cast("int"))
        return F.when(raw(key).isNull(), F.lit(default).cast("int")).otherwise(F.when(v >= least, v))

    known = KNOWN + [old for olds in OLD_NAMES.values() for old in olds]
    is_text = F.from_json(payload, "map<string,variant>")
    unknown = F.map_filter(is_text, lambda k, v: ~k.isin(known) & (F.schema_of_variant(v) == "STRING"))
    unknown = F.transform_values(unknown, lambda k, v: v.cast("string"))
    given = F.coalesce(F.from_json(raw("extra"), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    unknown = F.map_filter(unknown, lambda k, _: ~F.map_contains_key(given, k))
    unit = F.from_json(raw("parent_unit"), "struct<ref:string,summary:string>")
    out = keyed.select(
        *rows.columns,
        F.when(F.length(F.trim(raw("file_path"))) > 0, raw("file_path")).alias("file_path"),
        count("chunk_index", 0, 0).alias("chunk_index"),
        count("total_chunks", 1, 1).alias("total_chunks"),
        raw("section_header").alias("section_header"),
        count("start_line", 0, None).alias("start_line"),
        count("end_line", 0, None).alias("end_line"),
        source_type(raw("source_type")).alias("source_type"),
        known_role(raw("file_role")).alias("file_role"),
        raw("language").alias("language"),
        F.when(raw("file_hash").rlike("^[0-9a-fA-F]{64}$"), raw("file_hash")).alias("file_hash"),
        F.when(raw("chunk_hash").rlike("^[0-9a-fA-F]{64}$"), raw("chunk_hash")).alias("chunk_hash"),
        raw("summary").alias("summary"),
        F.when(F.length(F.trim(unit.ref)) > 0, unit).alias("parent_unit"),
        F.coalesce(parse_edges(raw("edges")), F.array().cast(EDGES)).alias("edges"),
        F.filter(F.coalesce(F.from_json(raw("tags"), "array<string>"), F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tags"),
        F.map_concat(unknown, given).alias("extra"),
    )
    return out.withColumn("end_line", F.when(F.col("start_line").isNull() | (F.col("end_line") >= F.col("start_line")), F.col("end_line")))


#: Metadata keys that have a field of their own.
CONSUMED = "fileHash chunkHash filePath sourceId sourceType mastraDocSummary".split()


def parent_unit(metadata: Column) -> Column:
    """The unit a chunk belongs to: its session, by id, described by the session's status; null without a session."""
    at = lambda k: F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    return F.when(at("session.id").isNotNull(), F.struct(F.concat(F.lit("session-"), at("session.id")).alias("ref"), at("session.status").alias("summary")))


def wire(chunks: DataFrame) -> DataFrame:
    """``(bank, path, chunk_index, content, importance, payload)`` of chunk rows: the payload of version 1 as JSON.

    Nulls and an empty path are left out; metadata that has no field of its own becomes ``extra``, absent if there is none.
    """
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kind = source_type(F.try_element_at(m, F.lit("sourceType")))
    extra = F.map_filter(m, lambda k, _: ~k.isin(CONSUMED))
    has = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    fields = {
        "contract_version": F.lit(1), "file_path": F.nullif(F.col("path"), F.lit("")), "chunk_index": F.col("chunk_index"), "total_chunks": F.col("total_chunks"), "section_header": F.col("section_header"), "start_line": has("start_line"), "end_line": has("end_line"),
        "source_type": F.when(kind != "unknown", kind), "file_role": F.col("file_role"), "language": has("language"), "file_hash": F.col("file_hash"), "chunk_hash": F.col("chunk_hash"), "summary": F.try_element_at(m, F.lit("mastraDocSummary")),
        "parent_unit": parent_unit(m), "edges": F.col("edges"), "tags": F.col("tags"), "extra": F.when(F.size(extra) > 0, extra),
    }
    return chunks.select("bank", "path", "chunk_index", F.col("chunk").alias("content"), "importance", payload(fields).alias("payload"))


def payload(columns: dict[str, Column]) -> Column:
    """The JSON payload of a chunk: the given columns under their names, nulls left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))
