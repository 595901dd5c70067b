"""Columns that classify a path: extension, chunker, document type, role, routing, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by role and by chunker.
MARKDOWN_EXTENSIONS = [".md", ".mdx", ".markdown"]
HTML_EXTENSIONS = [".html", ".htm"]
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg", ".conf"]
CODE_EXTENSIONS = (
    ".ts .tsx .js .jsx .py .go .java .rs .cs .php .rb .swift .kt .scala .cpp .c .h .hpp .m .mm .ex .exs .hs .pl .r .lua .dart .groovy"
).split()
SOURCE_TYPES = ["obsidian", "agent-sessions", "vault"]
FILE_ROLES = ["config", "code", "docs"]
#: Longest chunk by role, in characters.
MAX_CHARS = {"docs": 200, "code": 400, "config": 300}
#: Names never watched.
IGNORED_NAMES = [".git", "node_modules", ".DS_Store", "Thumbs.db"]


def extension(path: Column) -> Column:
    """The lower-cased text from the last dot of the whole path on; empty without a dot."""
    return F.when(F.instr(path, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path without its last part; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def chunker(path: Column) -> Column:
    """Which chunker takes a path: markdown, recursive, json or sentence."""
    ext, base = extension(path), basename(path)
    return (
        F.when(ext.isin(MARKDOWN_EXTENSIONS + HTML_EXTENSIONS), "markdown")
        .when(ext.isin(CODE_EXTENSIONS), "recursive")
        .when(ext.isin(CONFIG_EXTENSIONS) | base.startswith(".env"), "json")
        .otherwise("sentence")
    )


def document_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(MARKDOWN_EXTENSIONS), "markdown").when(ext == ".json", "json").when(ext.isin(HTML_EXTENSIONS), "html").otherwise("text")


def file_role(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(CONFIG_EXTENSIONS), "config").when(ext.isin(CODE_EXTENSIONS), "code").otherwise("docs")


def source_type(value: Column) -> Column:
    """A known source type, else ``unknown``; null is unknown."""
    return F.when(value.isin(SOURCE_TYPES), value).otherwise(F.lit("unknown"))


def known_role(value: Column) -> Column:
    """A known role, else null."""
    return F.when(value.isin(FILE_ROLES), value)


def max_chars(role: Column) -> Column:
    return F.when(role == "code", MAX_CHARS["code"]).when(role == "config", MAX_CHARS["config"]).otherwise(MAX_CHARS["docs"])


def chunk_bounds(limit: Column) -> Column:
    """``struct(max, min, target, overlap)`` of a chunk size."""
    part = lambda x: F.floor(limit * x).cast("int")
    return F.struct(
        limit.cast("int").alias("max"),
        part(0.5).alias("min"),
        part(0.75).alias("target"),
        F.when(limit <= 4, 0).otherwise(part(0.25)).cast("int").alias("overlap"),
    )


def summary_words(tokens: Column) -> Column:
    return F.greatest(F.lit(20), F.least(F.lit(120), F.floor(tokens / 200))).cast("int")


def is_index_file(path: Column, note_type: Column) -> Column:
    """Whether a note is a table of contents and is left out."""
    return basename(path).isin("_index.md", "_Vault-Home.md") | F.coalesce(note_type == "index", F.lit(False))


def matches_glob(path: Column, pattern: str) -> Column:
    """``*``, ``*.ext``, ``**/x/**`` (anywhere in the path), ``**/x`` (at the end), or the whole name."""
    if pattern in ("*", "**"):
        return F.lit(True)
    if pattern.startswith("**/") and pattern.endswith("/**"):
        return path.contains(pattern[3:-3])
    if pattern.startswith("**/"):
        return path.endswith(pattern[3:])
    if pattern.startswith("*."):
        return path.endswith(pattern[1:])
    return path == pattern


def is_ignored(path: Column, patterns: list[str] = ()) -> Column:
    """Whether any part of the path is a name never watched, an ``.env`` file, or matches a pattern."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED_NAMES])) | F.exists(parts, lambda p: p.startswith(".env"))
    for p in patterns:
        out = out | matches_glob(path, p)
    return out
