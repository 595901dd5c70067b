"""Documents to ordered chunks: one row per chunk, densely numbered, with the total on every row."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import classify, score, text
from memloom.functions.batches import bounded

NOT_BLANK = r"[^ \t\r\f]"
SECTION = r"(?m)(?=^#{1,6} )"
#: A piece between spaces that is blank.
_BLANK = re.compile(r"(?:\A| )\s*(?= |\Z)")


def line_chunks(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without ``content``, with ``chunk_index``, ``total_chunks`` and ``chunk``: one row per line that is not blank.

    The numbering happens within each row, so nothing is shuffled. Null and blank contents give no row.
    """
    lines = F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: x.rlike(NOT_BLANK))
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    held = files.select(*rest, lines.alias("__l"))
    return held.select(*rest, F.size("__l").alias("total_chunks"), F.posexplode("__l").alias("chunk_index", "chunk"))


class Bounds(NamedTuple):
    """Sizes of chunks in characters: none is longer than ``most``; packing stops at ``target``, but chunks and pieces under
    ``least`` are joined up to ``most``; ``overlap`` is how much of the chunk before is said again, where there is room."""

    most: int
    least: int = 0
    target: int | None = None
    overlap: int = 0


def pack(pieces: list[str], bounds: Bounds, joint: str) -> list[str]:
    """Neighbouring pieces joined while they stay within the bounds."""
    out: list[str] = []
    for piece in pieces:
        size = len(out[-1]) + len(joint) + len(piece) if out else 0
        short = bool(out) and min(len(out[-1]), len(piece)) < bounds.least
        if out and size <= (bounds.most if short or bounds.target is None else bounds.target):
            out[-1] += joint + piece
        else:
            out.append(piece)
    return out


def overlapping(chunks: list[str], bounds: Bounds) -> list[str]:
    """Each chunk after the end of the one before, from a word's start on, where both fit."""
    out = chunks[:1]
    for before, own in zip(chunks, chunks[1:], strict=False):
        tail = before[-bounds.overlap :] if bounds.overlap else ""
        tail = tail if len(tail) == len(before) else tail.partition(" ")[2]
        out.append(f"{tail} {own}" if tail.strip() and len(tail) + 1 + len(own) <= bounds.most else own)
    return out


def split_recursive(content: str, limit: int, ladder: tuple[str, ...] = ("\n\n", "\n", " ")) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the coarsest separator that serves, else between characters."""
    if len(content) <= limit:
        return [content]
    if not ladder:
        return [content[i : i + limit] for i in range(0, len(content), limit)]
    if ladder == (" ",) and (lines := split_words(content, limit)) is not None:
        return lines
    parts = []
    for p in content.split(ladder[0]):
        if len(p) > limit:
            parts += [q for q in split_recursive(p, limit, ladder[1:]) if q.strip()]
        elif p.strip():
            parts.append(p)
    return pack(parts, Bounds(limit), ladder[0])


def blank_piece(content: str) -> bool:
    """Whether a piece between spaces is blank; in printable text, whose only white space is the space, two spaces or one at an end say so."""
    if content.isprintable():
        return "  " in content or content.startswith(" ") or content.endswith(" ")
    return _BLANK.search(content) is not None


def split_words(content: str, limit: int) -> list[str] | None:
    """``content`` cut at spaces, as many words as fit in each piece, without blank ones; null if a word is over ``limit``.

    The same as packing the words one by one: a piece ends at the last space that leaves it within the limit.
    """
    if blank_piece(content):
        content = " ".join([p for p in content.split(" ") if p.strip()])
    out, at, size = [], 0, len(content)
    while size - at > limit:
        cut = content.rfind(" ", at, at + limit + 1)
        if cut < 0:
            return None
        out.append(content[at:cut])
        at = cut + 1
    if at < size:
        out.append(content[at:])
    return out


def split_sentences(content: str, bounds: Bounds) -> list[str]:
    """Sentences packed up to the target."""
    sentences = [q for s in re.split(r"(?<=[.!?])\s+", content.strip()) for q in split_recursive(s, bounds.most)]
    return overlapping(pack(sentences, bounds, " "), bounds)


def split_text(content: str, bounds: Bounds) -> list[str]:
    return overlapping(split_recursive(content, bounds.most), bounds)


def split_markdown(content: str, bounds: Bounds) -> list[str]:
    """Sections by heading; what a long section is cut into overlaps, sections do not."""
    sections = re.split(SECTION, content) if "#" in content else [content]
    return [q for s in sections if s.strip() for q in split_text(s.strip("\n"), bounds)]


def split_json(content: str, bounds: Bounds) -> list[str]:
    """Members of a JSON object or array packed up to the limits; what is no JSON is split as text."""
    try:
        value = json.loads(content)
    except ValueError:
        return split_recursive(content, bounds.most)
    if isinstance(value, dict):
        members = [f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in value.items()]
    elif isinstance(value, list):
        members = [json.dumps(v, ensure_ascii=False) for v in value]
    else:
        return [content]
    return pack([q for m in members for q in split_recursive(m, bounds.most)], bounds, ",\n")


SPLITTERS = {"markdown": split_markdown, "recursive": split_text, "json": split_json, "sentence": split_sentences}


def split_one(content: str | None, kind: str, bounds: Bounds) -> list[str]:
    return [x for x in SPLITTERS[kind](content, bounds) if x.strip()] if content and content.strip() else []


def split_chunks(content: Column, kind: Column, limit: Column) -> Column:
    """The chunks of each content by its chunker, ``array<string>``, within the bounds of ``limit``; blank contents have none.

    Markdown and code overlap, JSON has a least size, sentences a least size, a target and an overlap. Batches are bounded,
    and filters on the chunks (an explode brings one) do not copy the column, so that each content is split once.
    """
    bounded()

    @F.pandas_udf("array<string>")
    def udf(contents: pd.Series, kinds: pd.Series, sizes: pd.DataFrame) -> pd.Series:
        out = []
        for c, k, (most, least, target, overlap) in zip(contents, kinds, sizes.itertuples(index=False), strict=True):
            bounds = {"json": Bounds(most, least), "sentence": Bounds(most, least, target, overlap)}.get(k, Bounds(most, overlap=overlap))
            out.append(split_one(c, k, bounds))
        return pd.Series(out, dtype=object)

    return udf.asNondeterministic()(content, kind, classify.chunk_bounds(limit))


def note_chunks(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``files(bank, path, source_type, content)`` → chunks with text, header, role, importance, tags and hashes.

    Obsidian, session and vault files with frontmatter start with that block as a chunk of
    its own; index files of a vault are left out; vault texts have their links cleaned.
    Every other file is chunked whole. Blank files give no row.
    """
    path, kind = F.col("path"), classify.source_type(F.col("source_type"))
    size = F.lit(None).cast("int")
    for role, n in (limits or classify.MAX_CHARS).items():
        size = F.when(classify.file_role(path) == role, n).otherwise(size)
    front = F.when(kind != "unknown", text.frontmatter(F.col("content")))
    rest = F.when(kind != "unknown", text.body(F.col("content"))).otherwise(F.col("content"))
    held = files.select("bank", "path", kind.alias("source_type"), F.sha2("content", 256).alias("file_hash"), front.alias("__f"), rest.alias("__b"), size.alias("__n"))
    skipped = (F.col("source_type") == "vault") & classify.is_index_file(path, text.front_value(F.col("__f"), "type"))
    held = held.filter(~skipped).withColumn("__b", F.when(F.col("source_type") == "vault", text.clean_wikilinks(F.col("__b"))).otherwise(F.col("__b")))
    head = F.when(F.col("__f").isNotNull(), F.array(F.concat(F.lit("---\n"), F.col("__f"), F.lit("\n---"))))
    parts = F.concat(F.coalesce(head, F.array().cast("array<string>")), split_chunks(F.col("__b"), classify.chunker(path), F.col("__n")))
    held = held.withColumn("__c", parts)
    role = classify.file_role(path)
    out = held.select("bank", "path", "source_type", "file_hash", role.alias("file_role"), F.size("__c").alias("total_chunks"), F.posexplode("__c").alias("chunk_index", "chunk"), "__f")
    heading = F.regexp_extract("chunk", r"^(#{1,6} [^\n]*)", 1)
    header = F.when(heading != "", heading).otherwise(path)
    noted = F.split(F.regexp_replace(F.coalesce(text.front_value(F.col("__f"), "tags"), F.lit("")), r"[\[\]]", ""), r"\s*,\s*")
    noted = F.filter(noted, lambda t: t != "")
    ext = F.regexp_replace(classify.extension(path), "^[.]", "")
    tags = text.assemble_tags(ext, F.col("bank"), F.col("chunk"), F.lit(None).cast("string"))
    tags = F.when(F.col("source_type") == "vault", text.merged_tags(tags, noted, 20)).otherwise(tags)
    return out.select(
        "bank", "path", "source_type", "file_role", "file_hash", "chunk_index", "total_chunks", "chunk",
        header.alias("section_header"),
        text.chunk_hash(F.col("chunk")).alias("chunk_hash"),
        score.importance(F.col("file_role"), F.col("chunk"), header).alias("importance"),
        tags.alias("tags"),
    )


def note_metadata(front: Column) -> Column:
    """All plain ``key: value`` lines of a frontmatter block as a map with lower-cased keys, the last of equals."""
    lines = F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z][\w-]*):[ \t]*\S.*$"), 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p.k))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p.k == k), -1).v)
    return F.map_from_arrays(keys, last)


def dotted(metadata: Column, prefix: str) -> Column:
    return F.transform_keys(metadata, lambda k, _: F.concat(F.lit(prefix + "."), k))


def yaml_json(front: Column) -> Column:
    """Whole YAML frontmatter as JSON, dates as ISO text; null where it is no mapping or no YAML."""

    def one(text: str | None) -> str | None:
        import yaml

        try:
            value = yaml.safe_load(text) if text else None
        except yaml.YAMLError:
            value = None
        return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, dict) else None

    bounded()

    @F.pandas_udf("string")
    def udf(fronts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in fronts], dtype=object)

    return udf(front)
