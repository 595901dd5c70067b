"""Columns over note texts: frontmatter, links, tags, hashes, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never keyword tags.
STOPWORDS = (
    "the a an is it in on at to for of and or but not this that was are were be has have had do does did will would could should may might must can "
    "his her their our your my with from by as about into through during before after above below between among upon"
).split()
KEYWORDS, TOKENS = 5, 200
#: Characters of a text that are looked through for keywords first; the rest only if these hold too few.
KEYWORD_HEAD = 512
SINCE_2020 = 1_577_836_800_000
#: What opens and ends a frontmatter block, and what a path in a text looks like.
OPENS, ENDS = "---\n", "\n---"
PATH_TOKEN = r"[\w./~-]+\.[A-Za-z][A-Za-z0-9]*\b"


def _front_end(text: Column) -> Column:
    """The place of the line break before a block's closing line, from 1 on; 0 where a text has no block. Found without decoding the text."""
    return F.when(text.startswith(OPENS), F.locate(ENDS, text, len(OPENS) + 1)).otherwise(0)


def has_frontmatter(text: Column) -> Column:
    return _front_end(text) > 0


def frontmatter(text: Column) -> Column:
    """The block between the opening and closing ``---`` lines; null without one."""
    end = _front_end(text)
    return F.when(end > 0, F.substr(text, F.lit(len(OPENS) + 1), end - (len(OPENS) + 1)))


def body(text: Column) -> Column:
    end = _front_end(text)
    after = end + len(ENDS)
    return F.when(end > 0, F.substr(text, after + (F.substr(text, after, F.lit(1)) == "\n").cast("int"))).otherwise(text)


def front_value(front: Column, key: str) -> Column:
    """The plain value of one top-level ``key: value`` line; null without it."""
    value = F.trim(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.when(value != "", F.regexp_replace(value, r"^[\"'](.*)[\"']$", "$1"))


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target]]``, ``[[target|alias]]``, ``[[target#part]]``, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]*)[^\]]*\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def clean_wikilinks(text: Column) -> Column:
    """Links replaced by their alias, or their target where the alias is blank."""
    aliased = F.regexp_replace(text, r"!?\[\[[^\]|]*\|\s*([^\]\s](?:[^\]]*[^\]\s])?)\s*\]\]", "$1")
    return F.regexp_replace(aliased, r"!?\[\[\s*([^\]|#]*?)\s*(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]", "$1")


def path_tokens(text: Column, limit: int = TOKENS) -> Column:
    """The first ``limit`` distinct path-like tokens."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(PATH_TOKEN), 0)), 1, limit)


def expand_tilde(token: Column, home: str) -> Column:
    return F.regexp_replace(token, r"^~(?=/|$)", home.replace("$", r"\$"))


def mentions(text: Column, name: Column) -> Column:
    """Whether ``name`` stands alone in the text: no word, dot, slash or dash before, no word character after."""
    quoted = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\w./-])"), quoted, F.lit(r"(?!\w)")))


def chunk_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def file_id(bank: Column, path: Column) -> Column:
    """The id a path has in a bank, the same in every run."""
    return F.concat(F.lit("file_"), F.substring(F.sha2(F.concat(bank, F.lit(":"), path), 256), 1, 32))


def memory_id(bank: Column, hashed: Column) -> Column:
    """The id of a content in a bank: equal contents share it, so deduplication needs no lookup."""
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat(bank, F.lit(":"), hashed), 256), 1, 32))


def chunk_id(file: Column, memory: Column) -> Column:
    return F.concat_ws("_", F.lit("fc"), file, memory)


def relation_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws("_", F.lit("fr"), source, target, kind)


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def keyword_tags(text: Column, limit: int = KEYWORDS) -> Column:
    """The first ``limit`` distinct words of four or more characters that are no stop words."""

    def words_of(lowered: Column) -> Column:
        long = F.regexp_extract_all(lowered, F.lit("[a-z0-9]{4,}"), 0)
        return F.slice(F.array_except(long, F.array(*[F.lit(w) for w in STOPWORDS])), 1, limit)

    whole = F.coalesce(text, F.lit(""))
    # the word that the head may end within is left out, so enough words of the head are the first of the whole text
    head = words_of(F.regexp_replace(F.lower(F.substring(whole, 1, KEYWORD_HEAD)), r"[a-z0-9]+\z", ""))
    enough = F.get(F.filter(F.array(F.when(F.length(whole) > KEYWORD_HEAD, head)), lambda x: F.size(x) >= limit), F.lit(0))
    return F.coalesce(enough, words_of(F.lower(whole)))


def separated_tags(keywords: Column) -> Column:
    """Tags of a text separated by commas, semicolons or bars."""
    pieces = F.transform(F.split(F.coalesce(keywords, F.lit("")), "[;,|]+"), lambda t: F.lower(F.trim(t)))
    return F.filter(pieces, lambda t: t != "")


def file_type_tag(kind: Column) -> Column:
    return F.when(F.trim(kind) != "", F.concat(F.lit("file-type:"), F.lower(F.trim(kind))))


def location_tag(bank: Column) -> Column:
    return F.when(F.trim(bank) != "", F.concat(F.lit("location:"), bank))


def assemble_tags(kind: Column, bank: Column, text: Column, keywords: Column, limit: int = 10) -> Column:
    """File type, location, keywords of the text, given keywords: each tag once, at most ``limit``.

    Where the limit cuts, tags that look like a file type or a location go first, as those two do.
    """
    every = F.array_distinct(
        F.concat(F.filter(F.array(file_type_tag(kind), location_tag(bank)), lambda t: t.isNotNull()), keyword_tags(text), separated_tags(keywords))
    )
    is_type, is_place = lambda t: t.startswith("file-type:"), lambda t: t.startswith("location:")
    ordered = F.concat(F.filter(every, is_type), F.filter(every, is_place), F.filter(every, lambda t: ~is_type(t) & ~is_place(t)))
    return F.when(F.size(every) <= limit, every).otherwise(F.slice(ordered, 1, limit))


def merged_tags(old: Column, new: Column, limit: int | None = None) -> Column:
    """Both lists without repeats, the old one first."""
    empty = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))
    return both if limit is None else F.slice(both, 1, limit)


def mechanical_summary(path: Column, keywords: Column, tags: Column) -> Column:
    """What stands for a missing summary: the path, up to five keywords, up to five tags."""
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name), F.array_join(F.slice(xs, 1, 5), ", ")))
    return F.concat_ws(". ", F.when(path != "", F.concat(F.lit("File: "), path)), listed("Keywords: ", keywords), listed("Tags: ", tags))


def file_document(path: Column, keywords: Column, tags: Column) -> Column:
    """The lower-cased text that full-text search looks at."""
    return F.lower(F.concat_ws(" ", path, F.array_join(keywords, " "), F.array_join(tags, " ")))


def snowflake(millis: Column, node: Column, sequence: Column) -> Column:
    """An id of 41 bits of milliseconds since 2020 began, 10 of a node and 12 of a sequence number."""
    since = millis - F.lit(SINCE_2020)
    return F.shiftleft(since, 22).bitwiseOR(F.shiftleft(node.bitwiseAND(F.lit(1023)).cast("long"), 12)).bitwiseOR(sequence.bitwiseAND(F.lit(4095)).cast("long"))


def chunk_number(path: Column, index: Column) -> Column:
    """An id for a chunk that is the same in every run."""
    return F.xxhash64(path, index)


def snowflake_parts(value: Column) -> Column:
    """``struct(millis, node, sequence)`` of an id of 41, 10 and 12 bits."""
    return F.struct(
        F.shiftright(value, 22).alias("millis"),
        F.shiftright(value, 12).bitwiseAND(F.lit(1023)).cast("int").alias("node"),
        value.bitwiseAND(F.lit(4095)).cast("int").alias("sequence"),
    )
