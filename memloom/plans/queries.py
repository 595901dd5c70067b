"""Registered queries over the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import classify, contract, score, text
from memloom.operators import chunk, evaluate, lifecycle, links, project, retrieve, strategies
from memloom.operators.postings import TrigramIndex
from memloom.operators.recall_index import RecallIndex
from memloom.plans.corpus import Corpus
from memloom.sources.files import bounded_walk, listing_changes
from memloom.sources.shared import new_folder, written
from memloom.sources.store import Store
from memloom.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Views of the driver's tables that the SQL below starts from.
VIEWS = {
    "docs": """SELECT doc_id, coalesce(source, 'none') AS bank, coalesce(lang, '') AS lang, coalesce(text, '') AS content,
      '/' || coalesce(source, 'none') || '/' || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.ts' WHEN 2 THEN '.json' ELSE '.txt' END) AS path,
      CASE doc_id % 4 WHEN 0 THEN 'obsidian' WHEN 1 THEN 'agent-sessions' WHEN 2 THEN 'vault' ELSE 'unknown' END AS source_type,
      CASE doc_id % 4 WHEN 1 THEN 'code' WHEN 2 THEN 'config' ELSE 'docs' END AS file_role FROM documents""",
    "lines": r"""SELECT doc_id, bank, lang, path, source_type, file_role, file_id, len(l) AS total_chunks, c AS chunk, i - 1 AS chunk_index, sha256(c) AS chunk_hash,
      'mem_' || substr(sha256(bank || ':' || sha256(c)), 1, 32) AS memory_id, full_hash FROM (SELECT *, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_id, bank, lang, path, source_type, file_role, 'file_' || substr(sha256(bank || ':' || path), 1, 32) AS file_id, sha256(content) AS full_hash,
      list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]')) AS l FROM docs))""",
    "memories": """SELECT bank, memory_id, min(chunk) AS content, 0.5::DOUBLE AS importance, CASE WHEN count(*) > 1 THEN 'episodic' ELSE 'working' END AS scope FROM lines GROUP BY 1, 2""",
    "chunks": """SELECT file_id, memory_id, max(chunk_index) AS chunk_index, max(chunk_index) + 1 AS start_line, max(chunk_index) + 1 AS end_line, 'unit ' || (max(chunk_index) // 3) AS unit FROM lines GROUP BY 1, 2""",
    "files": """SELECT 'file_' || substr(sha256(bank || ':' || path), 1, 32) AS id, doc_id, bank, path, lang, source_type, file_role, sha256(content) AS file_hash, CASE WHEN doc_id % 3 = 0 THEN 'Summary of ' || doc_id END AS summary FROM docs""",
    "rels": """SELECT 'fr_' || s || '_' || t || '_' || k AS id, s, t, k, w FROM (
      SELECT a.id AS s, b.id AS t, 'sibling' AS k, 0.5::DOUBLE AS w FROM files a JOIN files b ON b.doc_id = a.doc_id + 20 AND a.bank = b.bank
      UNION ALL SELECT a.id, b.id, 'recommendation', 0.7::DOUBLE FROM files a JOIN files b ON b.doc_id = a.doc_id * 2 AND a.bank = b.bank
      UNION ALL SELECT a.id, f.t, 'version', 1.0::DOUBLE FROM files a JOIN (SELECT bank, file_hash, min_by(id, doc_id) AS t FROM files GROUP BY 1, 2) f ON a.bank = f.bank AND a.file_hash = f.file_hash) WHERE s <> t""",
    "rows_": """SELECT bank, 'file_' || substr(sha256(bank || ':/' || bank || '/' || (doc_id // 40) || '.md'), 1, 32) AS file_id, '/' || bank || '/' || (doc_id // 40) || '.md' AS path,
      '/' || bank || '/' || (doc_id // 40 + 1) || '.md' AS target_path, 'file_' || substr(sha256(bank || ':/' || bank || '/' || (doc_id // 40 + 1) || '.md'), 1, 32) AS target_id,
      doc_id * 1000000 + chunk_index AS seq, doc_id, memory_id, chunk_index, chunk_hash, lang, source_type, file_role, CASE WHEN doc_id % 7 <> 0 THEN full_hash END AS file_hash FROM lines""",
    "known": """SELECT *, last_value(file_hash IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM rows_""",
    "ep": """SELECT *, sum(CASE WHEN k IS NOT NULL AND file_hash IS DISTINCT FROM k THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq) AS epoch FROM known""",
    "latest": """SELECT * FROM (SELECT *, max(epoch) OVER (PARTITION BY file_id) AS e FROM ep) WHERE epoch = e""",
    "notes": """SELECT doc_id, bank, lang, '/' || bank || '/' || doc_id || '.md' AS path, content AS body0, '---' || chr(10) || 'type: ' || (CASE WHEN doc_id % 10 = 0 THEN 'index' ELSE 'note' END) || chr(10) || 'status: ' || lang || chr(10) ||
      'tags: [' || bank || ', ' || lang || ']' || chr(10) || 'see_also: ' || (doc_id * 2) || chr(10) || '---' || chr(10) || content || chr(10) ||
      'See [[' || (doc_id + 20) || '|next]] and [[' || (doc_id - 20) || '#part]] ![[missing ' || doc_id || ']] [[' || (doc_id + 20) || ']]' AS content FROM docs""",
    "note_links": r"""SELECT DISTINCT bank, doc_id, path, trim(x) AS link FROM (SELECT bank, doc_id, path, unnest(regexp_extract_all(content, '\[\[([^\]|#]*)[^\]]*\]\]', 1)) AS x FROM notes) WHERE trim(x) <> ''""",
    "sess": """SELECT conv_id, '/sessions/' || conv_id AS root, '/sessions/' || conv_id || '/' || (CASE turn WHEN 0 THEN 'session.md' WHEN 1 THEN 'specifications/spec.md' WHEN 2 THEN 'findings/findings.md' WHEN 3 THEN 'decisions/decisions.md'
      WHEN 4 THEN 'plans/implementation-plan.md' ELSE 'turns/turn-' || turn || '.md' END) AS path, coalesce(min(text), '') || ' see turns/turn-5.md and spec.md, or no-session.md' AS content FROM conversations GROUP BY conv_id, turn""",
    "toks": """SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS w FROM docs""",
    "found": """SELECT *, row_number() OVER (ORDER BY score DESC, memory_id) AS rank FROM (SELECT memory_id, round(count(*) / 4.0, 6) AS score FROM (
      SELECT DISTINCT memory_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS w FROM memories) WHERE w IN ('released', 'under', 'mit', 'license') GROUP BY 1) ORDER BY score DESC, memory_id LIMIT 10""",
    "first_chunk": """SELECT memory_id, arg_min(file_id, chunk_index * 1000000000000::HUGEINT + r) AS file_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY chunk_index, file_id) AS r FROM chunks) WHERE r = 1 GROUP BY 1""",
    "placed": """SELECT n.*, c.file_id, f.path, f.source_type, f.file_role FROM found n LEFT JOIN first_chunk c USING (memory_id) LEFT JOIN files f ON f.id = c.file_id""",
    "either": """SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY w DESC, id) AS n FROM (SELECT s AS file_id, t AS other_id, k, w, id FROM rels UNION ALL SELECT t, s, k, w, id FROM rels)""",
    "vault_files": """SELECT DISTINCT '/v' || (doc_id // 180) AS root, '/v' || (doc_id // 180) || (CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/sub' WHEN 2 THEN '/sub' WHEN 3 THEN '/deep/x' WHEN 4 THEN '/sub/y' ELSE '' END) || '/n' || (doc_id % 90) ||
      (CASE doc_id % 6 WHEN 2 THEN '.draft.md' WHEN 4 THEN '.png' WHEN 5 THEN '.draft.md' ELSE '.md' END) AS path, doc_id % 90 AS k FROM documents WHERE doc_id IS NOT NULL""",
    "vault_links": """SELECT DISTINCT root, path, link, regexp_replace(path, '/[^/]*$', '') AS own FROM (SELECT root, path, unnest(['n' || k, 'n' || (k + 6) % 90, 'n' || (k + 1) % 90, 'n' || (k + 2) % 90, 'n' || (k + 3) % 90, 'n' || (k + 4) % 90 || '.png', 'sub/n' || (k + 1) % 90,
      'sub/n' || (k + 2) % 90 || '.draft.md', 'deep/x/n' || (k + 5) % 90, 'n' || (k + 7) % 90 || '.draft', 'nothing here']) AS link FROM vault_files WHERE path LIKE '%.md')""",
    "rungs": """SELECT root, path, link, arg_min(target, r) AS target FROM (
      SELECT l.*, r, target FROM (SELECT *, unnest([1, 2, 3, 4]) AS r, unnest(CASE WHEN contains(link, '/') THEN [CASE WHEN regexp_matches(link, '[^/][.][^/]*$') THEN root || '/' || link END, root || '/' || m, NULL, NULL]
        ELSE [root || '/' || m, own || '/' || m, root || '/' || link, own || '/' || link] END) AS target FROM (SELECT *, CASE WHEN link LIKE '%.md' THEN link ELSE link || '.md' END AS m FROM vault_links)) l
      WHERE target <> path AND target IN (SELECT path FROM vault_files)) GROUP BY 1, 2, 3""",
    "walked": """SELECT root, path, regexp_extract(path, '[^/]+$') AS base, regexp_replace(regexp_extract(path, '[^/]+$'), '[.][^.]*$', '') AS stem FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS n FROM (
      SELECT root, path, length(path) - length(replace(path, '/', '')) AS depth FROM vault_files) WHERE depth <= 7) WHERE n <= 500""",
    "alone": """SELECT l.root, l.path, l.link, min(w.path) AS target FROM vault_links l JOIN walked w ON w.root = l.root AND w.path <> l.path AND (w.base = l.link OR w.stem = l.link OR starts_with(w.stem, l.link || '.'))
      WHERE NOT contains(l.link, '/') AND NOT EXISTS (SELECT 1 FROM rungs r WHERE r.path = l.path AND r.link = l.link) GROUP BY 1, 2, 3 HAVING count(*) = 1""",
    "front_notes": """SELECT doc_id, bank, lang, path, doc_id % 10 = 0 AS is_index, content FROM notes""",
    "note_parts": r"""SELECT doc_id, bank, lang, path, is_index, list_concat(['---' || chr(10) || 'type: ' || (CASE WHEN is_index THEN 'index' ELSE 'note' END) || chr(10) || 'status: ' || lang || chr(10) || 'tags: [' || bank || ', ' || lang || ']' || chr(10) || 'see_also: ' || (doc_id * 2) || chr(10) || '---'],
      list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]'))) AS parts FROM (SELECT *, regexp_extract(content, '(?s)^---\n(.*?)\n---\n?(.*)$', 2) AS body FROM front_notes)""",
    "relevant": """SELECT b.item_id, d.doc_id FROM benchmark b JOIN docs d ON contains(d.content, b.text) WHERE b.text <> ''""",
    "grams": """SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM docs))""",
    "asked": """SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))""",
    "got": """SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.item_id, g.doc_id, round(count(*) / any_value(n), 6) AS score FROM asked a JOIN grams g USING (g)
      JOIN (SELECT item_id, count(*)::DOUBLE AS n FROM asked GROUP BY 1) USING (item_id) GROUP BY 1, 2) QUALIFY rank <= 5""",
    "golden": """SELECT b.item_id AS query_id, coalesce(r.n, 0) AS n_relevant, coalesce(h.hits, 0) AS hits, coalesce(g.n, 0) AS n_got, h.first FROM (SELECT DISTINCT item_id FROM benchmark) b
      LEFT JOIN (SELECT item_id, count(*) AS n FROM relevant GROUP BY 1) r USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM got GROUP BY 1) g USING (item_id)
      LEFT JOIN (SELECT item_id, count(*) AS hits, min(rank) AS first FROM got JOIN relevant USING (item_id, doc_id) GROUP BY 1) h USING (item_id)""",
}


def sql(body: str) -> str:
    """``body`` with the views it needs, in their order."""
    needed, todo = set(), [body]
    while todo:
        t = todo.pop()
        for name in VIEWS:
            if name not in needed and any(f"{word}{name}{end}" in t.replace("\n", " ") + " " for word in ("FROM ", "JOIN ") for end in " )"):
                needed.add(name)
                todo.append(VIEWS[name])
    used = [n for n in VIEWS if n in needed]
    if used and body.startswith("WITH "):
        return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used) + ",\n" + body.removeprefix("WITH ")
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used) + "\n" if used else "") + body


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return f

    return register


# Ids, hashes, classes


@query("file_id_derivation", "SELECT doc_id, 'file_' || substr(sha256(bank || ':' || path), 1, 32) AS file_id FROM docs")
def file_id_derivation(c: Corpus) -> DataFrame:
    return c.documents().select("doc_id", text.file_id(F.col("bank"), F.col("path")).alias("file_id"))


@query("chunk_hash_dedup", "SELECT bank, memory_id, min(doc_id * 1000000 + chunk_index) AS first_seq, count(*) AS repeats FROM lines GROUP BY 1, 2")
def chunk_hash_dedup(c: Corpus) -> DataFrame:
    return project.deduplicated(c.lines().withColumn("seq", F.col("doc_id") * 1000000 + F.col("chunk_index"))).drop("chunk_hash")


@query("file_role_classify", "SELECT doc_id, file_role, CASE file_role WHEN 'code' THEN 400 WHEN 'config' THEN 300 ELSE 200 END AS max_chars FROM docs")
def file_role_classify(c: Corpus) -> DataFrame:
    role = classify.file_role(F.col("path"))
    return c.documents().select("doc_id", role.alias("file_role"), classify.max_chars(role).alias("max_chars"))


@query("chunker_choice", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'recursive' WHEN 2 THEN 'json' ELSE 'sentence' END AS chunker, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 2 THEN 'json' ELSE 'text' END AS document_type FROM docs")
def chunker_choice(c: Corpus) -> DataFrame:
    return c.documents().select("doc_id", classify.chunker(F.col("path")).alias("chunker"), classify.document_type(F.col("path")).alias("document_type"))


@query("source_type_route", "SELECT source_type, count(*) AS n FROM docs GROUP BY 1")
def source_type_route(c: Corpus) -> DataFrame:
    return c.documents().groupBy(classify.source_type(F.col("source_type")).alias("source_type")).agg(F.count("*").alias("n"))


# Texts


@query("frontmatter_split", r"SELECT doc_id, sha256(regexp_extract(content, '(?s)^---\n(.*?)\n---\n?(.*)$', 1)) AS front, sha256(regexp_extract(content, '(?s)^---\n(.*?)\n---\n?(.*)$', 2)) AS body FROM notes")
def frontmatter_split(c: Corpus) -> DataFrame:
    x = F.col("content")
    return c.notes().select("doc_id", F.sha2(text.frontmatter(x), 256).alias("front"), F.sha2(text.body(x), 256).alias("body"))


@query("wikilink_extract", "SELECT doc_id, link FROM note_links")
def wikilink_extract(c: Corpus) -> DataFrame:
    return c.notes().select("doc_id", F.explode(text.wikilinks(F.col("content"))).alias("link"))


@query("wikilink_clean", "SELECT doc_id, sha256(body0 || chr(10) || 'See next and ' || (doc_id - 20) || ' missing ' || doc_id || ' ' || (doc_id + 20)) AS cleaned FROM notes")
def wikilink_clean(c: Corpus) -> DataFrame:
    return c.notes().select("doc_id", F.sha2(text.clean_wikilinks(text.body(F.col("content"))), 256).alias("cleaned"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_WORDS = rf"string_split_regex(regexp_replace(lower(content), '[^a-z0-9\s]', ' ', 'g'), '\s+')"
_TAGS = f"""SELECT doc_id, w AS tag, r FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, w, min(i) AS i FROM (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_WORDS} AS l FROM docs)) WHERE length(w) >= 4 AND w NOT IN ({_STOP}) GROUP BY 1, 2)) WHERE r <= 5"""


@query("keyword_tags", f"SELECT doc_id, tag, (r - 1)::INT AS place FROM ({_TAGS})")
def keyword_tags(c: Corpus) -> DataFrame:
    return c.documents().select("doc_id", F.posexplode(text.keyword_tags(F.col("content"))).alias("place", "tag"))


@query(
    "tag_assembly",
    f"""SELECT d.doc_id, 'file-type:' || regexp_extract(path, '[a-z]+$') || '|location:' || bank || coalesce('|' || t.tags, '') || CASE WHEN lang <> '' AND (t.tags IS NULL OR NOT list_contains(string_split(t.tags, '|'), lang)) THEN '|' || lang ELSE '' END AS tags
    FROM docs d LEFT JOIN (SELECT doc_id, string_agg(tag, '|' ORDER BY r) AS tags FROM ({_TAGS}) GROUP BY 1) t USING (doc_id)""",
)
def tag_assembly(c: Corpus) -> DataFrame:
    ext = F.regexp_extract("path", "[a-z]+$", 0)
    return c.documents().select("doc_id", F.array_join(text.assemble_tags(ext, F.col("bank"), F.col("content"), F.concat("lang", F.lit(" ; "))), "|").alias("tags"))


_LEN = "least(0.1, 0.1 * (1 - exp(-length(chunk) / 250.0)))"
_MARK = "least(0.3, 0.1 * (" + " + ".join(f"contains(upper(chunk), '{m}')::INT" for m in score.MARKERS) + "))"


@query("importance_score", f"SELECT file_id, chunk_index::INT AS chunk_index, round(least(1, greatest(0, 0.5 + 0.4 * (CASE file_role WHEN 'docs' THEN 0.8 WHEN 'code' THEN 0.7 ELSE 0.6 END) + 0.2 * {_LEN} + 0.3 * {_MARK})), 6)::DOUBLE AS importance FROM lines")
def importance_score(c: Corpus) -> DataFrame:
    return c.lines().select("file_id", "chunk_index", F.round(score.importance(classify.file_role(F.col("path")), F.col("chunk"), F.lit("")), 6).alias("importance"))


@query("header_factor", "SELECT file_id, chunk_index::INT AS chunk_index, round(0.05 * CASE WHEN doc_id % 7 > 1 THEN doc_id % 7 - 1 ELSE 0 END, 6)::DOUBLE AS factor FROM lines")
def header_factor(c: Corpus) -> DataFrame:
    """Every line as a heading of its document's number modulo seven."""
    heading = F.concat(F.repeat(F.lit("#"), F.pmod("doc_id", F.lit(7)).cast("int")), F.lit(" "), "chunk")
    return c.lines().select("file_id", "chunk_index", F.round(score.header_factor(heading), 6).alias("factor"))


@query("mechanical_summary", f"SELECT f.id, 'File: ' || path || coalesce('. Keywords: ' || t.tags, '') || '. Tags: lang-' || lang || ', ' || bank AS summary FROM files f LEFT JOIN (SELECT doc_id, string_agg(tag, ', ' ORDER BY r) AS tags FROM ({_TAGS}) GROUP BY 1) t USING (doc_id)".replace("FROM docs)", "FROM (SELECT doc_id, coalesce(text, '') AS content FROM documents))"))
def mechanical_summary(c: Corpus) -> DataFrame:
    return c.files().select("id", text.mechanical_summary(F.col("path"), F.col("keywords"), F.col("tags")).alias("summary"))


@query("normalized_text", r"SELECT doc_id, sha256(trim(regexp_replace(lower(content), '[\s\x0B]+', ' ', 'g'))) AS normalized FROM docs")
def normalized_text(c: Corpus) -> DataFrame:
    return c.documents().select("doc_id", F.sha2(text.normalized(F.col("content")), 256).alias("normalized"))


# Payloads


def _payloads(c: Corpus) -> DataFrame:
    n, even = F.col("doc_id"), F.pmod("doc_id", F.lit(2)) == 0
    edges = F.array(
        F.struct(F.lit("/a.md").alias("target_path"), F.when(even, "sibling").otherwise("friend").alias("relation_type"), F.lit(0.5).alias("strength")),
        F.struct(F.concat(F.lit("/"), n.cast("string")).alias("target_path"), F.lit("version").alias("relation_type"), (F.pmod("doc_id", F.lit(5)) / 2).alias("strength")),
        F.struct(F.lit(" ").alias("target_path"), F.lit("sibling").alias("relation_type"), F.lit(0.5).alias("strength")),
    )
    fields = {
        "file_path": F.when(even, F.col("path")), "breadcrumb": F.when(~even, F.col("path")), "chunk_index": F.pmod("doc_id", F.lit(50)) - 1, "totalChunks": F.pmod("doc_id", F.lit(4)),
        "fileRole": F.when(even, "code").otherwise("poem"), "source_type": F.col("source_type"), "language": F.col("lang"), "hash": F.sha2("content", 256), "chunk_hash": F.lit("short"),
        "startLine": F.lit(7), "end_line": F.pmod("doc_id", F.lit(10)).cast("int"), "note.title": F.col("bank"), "depth": F.lit(3), "session.id": F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("lang")), "spare": F.when(F.pmod("doc_id", F.lit(5)) == 0, "ignored"), "extra": F.when(F.pmod("doc_id", F.lit(5)) == 0, F.create_map(F.lit("spare"), F.lit("kept"))), "edges": edges, "tags": F.array("lang", "bank"), "parent_unit": F.struct(F.when(even, "session-1").otherwise("").alias("ref"), F.lit("open").alias("summary")),
    }
    return c.documents().select("doc_id", contract.payload(fields).alias("payload"))


@query(
    "contract_parse",
    """SELECT doc_id, path AS file_path, CASE WHEN doc_id % 50 >= 1 THEN (doc_id % 50 - 1)::INT END AS chunk_index, CASE WHEN doc_id % 4 >= 1 THEN (doc_id % 4)::INT END AS total_chunks, source_type, CASE WHEN doc_id % 2 = 0 THEN 'code' END AS file_role,
    lang AS language, sha256(content) AS file_hash, NULL::VARCHAR AS chunk_hash, 7 AS start_line, CASE WHEN doc_id % 10 >= 7 THEN (doc_id % 10)::INT END AS end_line, lang || ',' || bank AS tags, CASE WHEN doc_id % 2 = 0 THEN 'session-1' END AS unit FROM docs""",
)
def contract_parse(c: Corpus) -> DataFrame:
    parsed = contract.parse(_payloads(c))
    names = "doc_id file_path chunk_index total_chunks source_type file_role language file_hash chunk_hash start_line end_line".split()
    return parsed.select(*names, F.array_join("tags", ",").alias("tags"), F.col("parent_unit.ref").alias("unit"))


@query("legacy_key_map", "SELECT doc_id, path AS file_path, 'note.title' AS key, bank AS value FROM docs UNION ALL SELECT doc_id, path, 'session.id', lang FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, path, 'spare', 'kept' FROM docs WHERE doc_id % 5 = 0")
def legacy_key_map(c: Corpus) -> DataFrame:
    return contract.parse(_payloads(c)).select("doc_id", "file_path", F.explode("extra").alias("key", "value"))


@query(
    "edge_parse",
    "SELECT doc_id, '/a.md' AS target_path, 'sibling' AS relation_type, 0.5::DOUBLE AS strength FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '/' || doc_id, 'version', (doc_id % 5) / 2.0::DOUBLE FROM docs WHERE doc_id % 5 <= 2",
)
def edge_parse(c: Corpus) -> DataFrame:
    return contract.parse(_payloads(c)).select("doc_id", F.inline("edges")).select("doc_id", "target_path", "relation_type", "strength")


# Chunks and files


@query("doc_chunks", "SELECT file_id, chunk_index::INT AS chunk_index, total_chunks::INT AS total_chunks, chunk_hash, memory_id FROM lines")
def doc_chunks(c: Corpus) -> DataFrame:
    return c.lines().select("file_id", "chunk_index", "total_chunks", "chunk_hash", "memory_id")


@query("note_chunks")
def note_chunks(c: Corpus) -> DataFrame:
    """Every document by the chunker of its path; tests hold the splitters against plain cases."""
    out = chunk.note_chunks(c.documents().select("bank", "path", "source_type", "content"))
    return out.select("path", "chunk_index", "total_chunks", "chunk_hash", "file_role", F.round("importance", 6).alias("importance"), F.array_join("tags", "|").alias("tags"))


def _cut_sql(value: str, most: int, depth: int = 0) -> str:
    """SQL for the pieces of ``value``, cut at blank lines, line ends, spaces, then anywhere; ``depth`` names the variables."""
    joint, v = ("\n\n", "\n", " ", "")[depth], f"v{depth}"
    if depth == 3:
        return f"(CASE WHEN length({value}) <= {most} THEN [{value}] ELSE list_transform(range(0, length({value}), {most}), lambda i: substr({value}, i + 1, {most})) END)"
    glue = " || ".join("chr(10)" if ch == "\n" else f"'{ch}'" for ch in joint)
    parts = f"list_filter(flatten(list_transform(string_split({value}, {glue}), lambda {v}: {_cut_sql(v, most, depth + 1)})), lambda q: regexp_matches(q, '[^\\s\\x0B]'))"
    return f"(CASE WHEN length({value}) <= {most} THEN [{value}] ELSE {_packed(parts, joint, most)} END)"


def _packed(pieces: str, joint: str, most: int, least: int = 0, target: int | None = None) -> str:
    """SQL that joins neighbours of the list ``pieces`` while they stay within the bounds."""
    room = f"(CASE WHEN least(length(a[-1]), length(x[1])) < {least} THEN {most} ELSE {target or most} END)"
    glue = " || ".join("chr(10)" if ch == "\n" else f"'{ch}'" for ch in joint)
    fold = f"list_reduce(list_transform(p, lambda y: [y]), lambda a, x: CASE WHEN length(a[-1]) + {len(joint)} + length(x[1]) <= {room} THEN list_concat(a[1:len(a) - 1], [a[-1] || {glue} || x[1]]) ELSE list_concat(a, x) END)"
    return f"list_transform([{pieces}], lambda p: CASE WHEN len(p) = 0 THEN []::VARCHAR[] ELSE {fold} END)[1]"


def _overlap_sql(chunks: str, most: int, overlap: int) -> str:
    """SQL that starts each chunk with the end of the one before, where both fit."""
    tail = f"(CASE WHEN length(c[i - 1]) <= {overlap} THEN c[i - 1] WHEN contains(right(c[i - 1], {overlap}), ' ') THEN substr(right(c[i - 1], {overlap}), strpos(right(c[i - 1], {overlap}), ' ') + 1) ELSE '' END)"
    own = f"CASE WHEN i > 1 AND regexp_matches({tail}, '[^\\s\\x0B]') AND length({tail}) + 1 + length(c[i]) <= {most} THEN {tail} || ' ' || c[i] ELSE c[i] END"
    return f"list_transform([{chunks}], lambda c: list_transform(range(1, len(c) + 1), lambda i: {own}))[1]"


def _shown(chunks: str) -> str:
    """SQL that leaves blank chunks out."""
    return f"list_filter({chunks}, lambda q: regexp_matches(q, '[^\\s\\x0B]'))"


def _markdown_sql(value: str) -> str:
    """SQL for the chunks of a Markdown text of at most 200 characters each: sections, overlapping inside."""
    sections = f"list_filter(string_split(regexp_replace({value}, '(?m)^(#{{1,6}} )', chr(1) || '\\1', 'g'), chr(1)), lambda z: regexp_matches(z, '[^\\s\\x0B]'))"
    return _shown(f"flatten(list_transform({sections}, lambda s: {_overlap_sql(_cut_sql('trim(s, chr(10))', 200), 200, 50)}))")


_LINES = r"list_filter(string_split({}, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]'))"
_CLEAN = r"regexp_replace(regexp_replace({}, '!?\[\[[^\]|]*\|\s*([^\]\s](?:[^\]]*[^\]\s])?)\s*\]\]', '\1', 'g'), '!?\[\[\s*([^\]|#]*?)\s*(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]', '\1', 'g')"
VIEWS["note_pieces"] = VIEWS["note_parts"].replace(_LINES.format("body"), _markdown_sql("body"))
VIEWS["clean_pieces"] = VIEWS["note_parts"].replace(_LINES.format("body"), _markdown_sql(_CLEAN.format("body")))


def _chunker_sql() -> str:
    """Markdown by sections, code by lines, what is no JSON as text, other texts by sentences, within the bounds of their roles."""
    by = {
        "md": _markdown_sql("content"),
        "ts": _overlap_sql(_cut_sql("content", 400), 400, 100),
        "json": _cut_sql("content", 300),
        "txt": _overlap_sql(_packed(f"flatten(list_transform(string_split(regexp_replace(regexp_replace(content, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), '([.!?])[\\s\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_cut_sql('s', 200)}))", " ", 200, 100, 150), 200, 50),
    }
    each = " UNION ALL ".join(f"SELECT path, {sql} AS l FROM docs WHERE regexp_matches(content, '[^\\s\\x0B]') AND path LIKE '%.{ext}'" for ext, sql in by.items())
    return f"""SELECT path, (i - 1)::INT AS chunk_index, len(l)::INT AS total_chunks, sha256(l[i]) AS chunk_hash, CASE WHEN regexp_matches(l[i], '^#{{1,6}} [^\\n]*') THEN regexp_extract(l[i], '^(#{{1,6}} [^\\n]*)', 1) ELSE path END AS section_header
      FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, {_shown("l")} AS l FROM ({each})))"""


@query("chunker_chunks", _chunker_sql())
def chunker_chunks(c: Corpus) -> DataFrame:
    """Every document as an ordinary file, by the chunker of its path, in the bounds of its role."""
    out = chunk.note_chunks(c.documents().select("bank", "path", F.lit("unknown").alias("source_type"), "content"))
    return out.select("path", "chunk_index", "total_chunks", "chunk_hash", "section_header")


def _session_files(c: Corpus) -> DataFrame:
    conv = F.regexp_extract("path", r"^/sessions/([^/]+)/", 1)
    front = F.when(F.col("path").endswith("/session.md"), F.concat(F.lit("---\nsessionId: s"), conv, F.lit("\n---\n"))).otherwise("")
    return c.sessions().select(F.lit("sessions").alias("bank"), "path", F.concat(front, "content").alias("content"))


def _strategy(rows: DataFrame) -> DataFrame:
    return rows.select("path", "chunk_index", "total_chunks", "chunk_hash", F.when(F.col("chunk_index") == 0, F.array_join("tags", "|")).alias("head_tags"), F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e.relation_type, e.target_path)), "|").alias("edges"), "metadata")


_HEAD = "CASE WHEN i = 1 THEN 'frontmatter|metadata|{kind}|' || bank || CASE WHEN lang <> '' THEN '|' || lang ELSE '' END END AS head_tags"


@query(
    "obsidian_chunks",
    f"""SELECT path, (i - 1)::INT AS chunk_index, len(parts)::INT AS total_chunks, sha256(parts[i]) AS chunk_hash, {_HEAD.format(kind='obsidian-note')}, e.edges, CASE WHEN is_index THEN 'index' ELSE 'note' END AS note_type, (doc_id * 2)::VARCHAR AS see_also,
    to_json(list_filter(l, lambda x, k: list_position(l, x) = k))::VARCHAR AS links FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM note_pieces) n
    JOIN (SELECT doc_id, string_agg('backlink /' || bank || '/' || link || '.md', '|' ORDER BY '/' || bank || '/' || link || '.md') AS edges FROM note_links GROUP BY 1) e USING (doc_id)
    JOIN (SELECT doc_id, list_filter(list_transform(regexp_extract_all(content, '\\[\\[([^\\]|#]*)[^\\]]*\\]\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS l FROM notes) w USING (doc_id)""",
)
def obsidian_chunks(c: Corpus) -> DataFrame:
    """All notes, by their chunker."""
    notes = c.notes()
    at = lambda k: F.try_element_at("metadata", F.lit(k))
    out = _strategy(strategies.obsidian_chunks(notes, notes))
    return out.select("*", at("note.type").alias("note_type"), at("note.properties.see_also").alias("see_also"), at("note.wikilinks").alias("links")).drop("metadata")


@query(
    "vault_chunks",
    f"""SELECT path, (i - 1)::INT AS chunk_index, (len(parts))::INT AS total_chunks, sha256(CASE WHEN i = 1 THEN replace(parts[1], 'see_also: ' || (doc_id * 2), 'see_also: [' || chr(39) || (doc_id * 2) || chr(39) || ']') ELSE parts[i] END) AS chunk_hash,
    {_HEAD.format(kind='vault-node')}, coalesce(e.edges, '') AS edges, lang AS note_status, '["' || (doc_id * 2) || '"]' AS see_also FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM clean_pieces WHERE NOT is_index) n
    LEFT JOIN (SELECT path, string_agg(DISTINCT t, '|' ORDER BY t) AS edges FROM (SELECT a.path, 'recommendation ' || b.path AS t FROM notes a JOIN notes b ON b.bank = a.bank AND b.doc_id = a.doc_id * 2 AND a.doc_id <> b.doc_id
      UNION ALL SELECT l.path, 'backlink ' || n.path FROM note_links l JOIN notes n ON n.path = '/' || l.bank || '/' || l.link || '.md' WHERE l.path <> n.path) GROUP BY 1) e USING (path)""",
)
def vault_chunks(c: Corpus) -> DataFrame:
    notes = c.notes().withColumn("content", F.regexp_replace("content", r"(?m)^see_also: (-?\d+)$", "see_also: ['$1']"))
    at = lambda k: F.try_element_at("metadata", F.lit(k))
    out = _strategy(strategies.vault_chunks(notes, notes))
    return out.withColumn("edges", F.coalesce("edges", F.lit(""))).select("*", at("note.status").alias("note_status"), at("note.see_also").alias("see_also")).drop("metadata")


@query(
    "session_chunks",
    r"""SELECT s.path, (i - 1)::INT AS chunk_index, len(parts)::INT AS total_chunks, sha256(parts[i]) AS chunk_hash, CASE WHEN i = 1 AND s.path LIKE '%/session.md' THEN 'frontmatter|metadata' END AS head_tags, coalesce(edges, '') AS edges, CASE WHEN r.path IS NOT NULL THEN 's' || conv_id ELSE '' END AS session_id FROM (
      SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, list_concat(CASE WHEN path LIKE '%/session.md' THEN ['---' || chr(10) || 'sessionId: s' || conv_id || chr(10) || '---'] ELSE [] END, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]'))) AS parts FROM sess)) s
    LEFT JOIN (SELECT conv_id, path FROM sess WHERE path LIKE '%/session.md') r USING (conv_id)
    LEFT JOIN (SELECT path, string_agg(t, '|' ORDER BY t) AS edges FROM (SELECT DISTINCT source_path AS path, relation_type || ' ' || target_path AS t FROM ({companions} UNION ALL {references})) GROUP BY 1) e ON e.path = s.path""".replace(_LINES.format("content"), _markdown_sql("content")).replace("{companions}", "SELECT a.path AS source_path, b.path AS target_path, CASE WHEN b.path LIKE '%/session.md' THEN 'parent_child' ELSE 'sibling' END AS relation_type FROM sess a JOIN sess b USING (conv_id) WHERE a.path <> b.path AND b.path NOT LIKE '%/turns/%' AND EXISTS (SELECT 1 FROM sess s WHERE s.path = a.root || '/session.md')").replace("{references}", r"SELECT a.path, b.path, 'cross_reference' FROM sess a JOIN sess b USING (conv_id) WHERE a.path <> b.path AND EXISTS (SELECT 1 FROM sess s WHERE s.path = a.root || '/session.md') AND (list_contains(regexp_extract_all(a.content, '[\w./~-]+\.[A-Za-z][A-Za-z0-9]*\b'), substr(b.path, length(b.root) + 2)) OR regexp_matches(a.content, '(^|[^\w./-])' || replace(regexp_extract(b.path, '[^/]+$'), '.', '\.') || '($|\W)'))"),
)
def session_chunks(c: Corpus) -> DataFrame:
    """Session files by their chunker; ``session.md`` starts with the session's id."""
    out = _strategy(strategies.session_chunks(_session_files(c))).withColumn("head_tags", F.when(F.col("path").endswith("/session.md"), F.col("head_tags")))
    return out.withColumn("session_id", F.try_element_at("metadata", F.lit("session.id"))).drop("metadata")


_SESSION_PARTS = "list_concat(CASE WHEN path LIKE '%/session.md' THEN ['---' || chr(10) || 'sessionId: s' || conv_id || chr(10) || '---'] ELSE [] END, " + _markdown_sql("content") + ")"
_EACH = "SELECT path, (i - 1)::INT AS chunk_index, len(parts)::INT AS total_chunks, sha256(parts[i]) AS chunk_hash, '{}' AS source_type FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM ({}))"


@query(
    "chunk_content",
    " UNION ALL ".join([
        _EACH.format("obsidian", "SELECT path, parts FROM note_pieces WHERE doc_id % 2 = 0"), _EACH.format("vault", "SELECT path, parts FROM clean_pieces WHERE doc_id % 2 = 1 AND NOT is_index"),
        _EACH.format("agent-sessions", f"SELECT path, {_SESSION_PARTS} AS parts FROM sess"), f"SELECT path, chunk_index, total_chunks, chunk_hash, 'unknown' FROM ({_chunker_sql()})",
    ]),
)
def chunk_content(c: Corpus) -> DataFrame:
    """Notes, a vault, sessions and other files through the one entry that routes them."""
    n = F.pmod("doc_id", F.lit(2))
    notes = c.notes().select("root", "bank", "path", F.when(n == 0, "obsidian").otherwise("vault").alias("source_type"), "content")
    sessions = _session_files(c).select(F.lit("/sessions").alias("root"), "bank", "path", F.lit("agent-sessions").alias("source_type"), "content")
    others = c.documents().select(F.lit("/").alias("root"), "bank", "path", F.lit("else").alias("source_type"), "content")
    return strategies.chunk_content(notes.unionByName(sessions).unionByName(others), once=False).select("path", "chunk_index", "total_chunks", "chunk_hash", "source_type")


@query(
    "contract_wire",
    r"""SELECT s.path AS file_path, (i - 1)::INT AS chunk_index, len(parts)::INT AS total_chunks, sha256(parts[i]) AS chunk_hash, CASE WHEN r.path IS NOT NULL THEN 'session-s' || conv_id END AS unit, 5 AS n_extra FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT *, list_concat(CASE WHEN path LIKE '%/session.md' THEN ['---' || chr(10) || 'sessionId: s' || conv_id || chr(10) || '---'] ELSE [] END, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]'))) AS parts FROM sess)) s
    LEFT JOIN (SELECT conv_id, path FROM sess WHERE path LIKE '%/session.md') r USING (conv_id)""",
)
def contract_wire(c: Corpus) -> DataFrame:
    """Session chunks written as payloads and read back."""
    sent = contract.wire(strategies.session_chunks(_session_files(c), strategies.lines)).select("payload")
    return contract.parse(sent).select("file_path", "chunk_index", "total_chunks", "chunk_hash", F.col("parent_unit.ref").alias("unit"), F.size("extra").alias("n_extra"))


@query("dense_reindex", "SELECT file_id, min(chunk_index)::INT AS first, max(chunk_index)::INT AS last, count(*) AS n FROM lines GROUP BY 1")
def dense_reindex(c: Corpus) -> DataFrame:
    return c.lines().groupBy("file_id").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count("*").alias("n"))


@query("note_metadata", "SELECT doc_id, 'note.' || k AS key, v AS value FROM (SELECT doc_id, unnest(['type', 'status', 'tags', 'see_also']) AS k, unnest([CASE WHEN doc_id % 10 = 0 THEN 'index' ELSE 'note' END, lang, '[' || bank || ', ' || lang || ']', (doc_id * 2)::VARCHAR]) AS v FROM notes) WHERE v <> ''")
def note_metadata(c: Corpus) -> DataFrame:
    return c.notes().select("doc_id", F.explode(chunk.dotted(chunk.note_metadata(text.frontmatter(F.col("content"))), "note")).alias("key", "value"))


@query("chunk_counts", "SELECT file_id, count(*) AS total_chunks FROM chunks GROUP BY 1")
def chunk_counts(c: Corpus) -> DataFrame:
    return c.file_chunks().groupBy("file_id").agg(F.count("*").alias("total_chunks"))


@query("fetch_whole", "SELECT file_id, sha256(string_agg(content, chr(10) ORDER BY chunk_index)) AS content, count(*)::INT AS n_chunks, 'complete' AS status FROM chunks JOIN memories USING (memory_id) GROUP BY 1")
def fetch_whole(c: Corpus) -> DataFrame:
    return retrieve.fetch_whole(c.file_chunks(), c.memories()).select("file_id", F.sha2("content", 256).alias("content"), "n_chunks", "status")


@query("fetch_neighbor", "SELECT file_id, chunk_index::INT AS chunk_index, position::INT AS position FROM (SELECT *, max(CASE WHEN chunk_index = 1 THEN position END) OVER (PARTITION BY file_id) AS at_ FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) AS position FROM chunks)) WHERE abs(position - at_) <= 2")
def fetch_neighbor(c: Corpus) -> DataFrame:
    centres = c.files().select(F.col("id").alias("file_id"), F.lit(1).alias("centre"))
    return retrieve.fetch_neighbours(c.file_chunks(), centres, 2).select("file_id", "chunk_index", "position")


@query("fetch_missing_centre", "SELECT file_id, 3 AS centre, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS available FROM chunks GROUP BY 1 HAVING count(*) FILTER (chunk_index = 3) = 0")
def fetch_missing_centre(c: Corpus) -> DataFrame:
    centres = c.file_chunks().select("file_id", F.lit(3).alias("centre")).distinct()
    return retrieve.missing_centres(c.file_chunks(), centres).withColumn("available", F.array_join(F.transform("available", lambda i: i.cast("string")), ","))


@query("fetch_with_metadata", "SELECT f.id AS file_id, f.path, f.file_role, f.file_hash, n::INT AS total_chunks FROM files f JOIN (SELECT file_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.file_id = f.id")
def fetch_with_metadata(c: Corpus) -> DataFrame:
    whole = retrieve.fetch_whole(c.file_chunks(), c.memories()).select("file_id", "status")
    return retrieve.with_file(whole, c.files(), c.file_chunks()).select("file_id", "file.path", "file.file_role", "file.file_hash", "total_chunks")


@query(
    "missing_chunk_markers",
    """SELECT file_id, sha256(string_agg(CASE WHEN length(content) >= 20 THEN content ELSE '<< missing chunk ' || memory_id || ' (index=' || chunk_index || ', lines=' || start_line || '-' || end_line || ') >>' END, chr(10) ORDER BY chunk_index)) AS content,
    CASE WHEN count(*) FILTER (length(content) < 20) > 0 THEN 'partial' ELSE 'complete' END AS status, (count(*) FILTER (length(content) < 20))::INT AS n_missing FROM chunks JOIN memories USING (memory_id) GROUP BY 1""",
)
def missing_chunk_markers(c: Corpus) -> DataFrame:
    """Contents under 20 characters count as lost (empty)."""
    known = c.memories().withColumn("content", F.when(F.length("content") >= 20, F.col("content")).otherwise(""))
    return retrieve.fetch_whole(c.file_chunks(), known).select("file_id", F.sha2("content", 256).alias("content"), "status", F.size("missing").alias("n_missing"))


# Recall and search

QUESTION = "Released under MIT License"


def _found(c: Corpus) -> DataFrame:
    asked = c.spark.sql(f"SELECT 0L AS query_id, '{QUESTION}' AS query")
    rows = retrieve.recall(c.lines().select("memory_id", F.col("chunk").alias("content")), asked, 10).drop("query_id")
    return written(rows, new_folder(c.spark, "found"))  # ten rows, read by each part of an answer


@query("recall_topk", "SELECT rank::INT AS rank, memory_id, score::DOUBLE AS score FROM found")
def recall_topk(c: Corpus) -> DataFrame:
    return _found(c)


@query("recall_indexed", "SELECT rank::INT AS rank, memory_id, score::DOUBLE AS score FROM found")
def recall_indexed(c: Corpus) -> DataFrame:
    """The same question to an index that ends early."""
    index = RecallIndex(c.spark, new_folder(c.spark, "runs")).build(c.memories().select("memory_id", "content"))
    return index.search(c.spark.sql(f"SELECT 0L AS query_id, '{QUESTION}' AS query"), 10).drop("query_id")


@query(
    "recall_cosine",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS memory_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 4) AS score FROM embeddings, q ORDER BY score DESC, memory_id LIMIT 10""",
)
def recall_cosine(c: Corpus) -> DataFrame:
    rows = c.table("embeddings")
    first = rows.orderBy("vec_id").select("embedding").first()
    return retrieve.recall_vectors(rows.select(F.col("vec_id").alias("memory_id"), "embedding"), [float(x) for x in (first[0] if first else [0.0])])


_GROUPS = """SELECT 'file' AS kind, file_id, path, string_agg(memory_id, ',' ORDER BY rank) AS memory_ids, max(score)::DOUBLE AS best_score, min(rank) AS at_ FROM placed WHERE {fits} GROUP BY file_id, path
  UNION ALL SELECT 'memory', NULL, NULL, memory_id, score::DOUBLE, rank FROM placed WHERE NOT coalesce({fits}, false)"""


def _search_sql(fits: str) -> str:
    return f"SELECT kind, file_id, path, memory_ids, best_score, (row_number() OVER (ORDER BY kind DESC, at_))::INT AS position FROM ({_GROUPS.format(fits=fits)})"


@query("search_files", _search_sql("path IS NOT NULL"))
def search_files(c: Corpus) -> DataFrame:
    return retrieve.search_files(_found(c), c.file_chunks(), c.files()).withColumn("memory_ids", F.array_join("memory_ids", ","))


@query("search_files_filtered", _search_sql("(path IS NOT NULL AND source_type = 'vault' AND file_role = 'config')"))
def search_files_filtered(c: Corpus) -> DataFrame:
    return retrieve.search_files(_found(c), c.file_chunks(), c.files(), "vault", "config").withColumn("memory_ids", F.array_join("memory_ids", ","))


@query("search_files_relations", f"""SELECT g.*, coalesce(r.r, '') AS relations FROM ({_search_sql("path IS NOT NULL")}) g LEFT JOIN (SELECT file_id, string_agg(id, ',' ORDER BY n) AS r FROM either WHERE n <= 3 GROUP BY 1) r USING (file_id)""")
def search_files_relations(c: Corpus) -> DataFrame:
    out = retrieve.search_files(_found(c), c.file_chunks(), c.files(), relations=c.relations(), k=3)
    return out.withColumn("memory_ids", F.array_join("memory_ids", ",")).withColumn("relations", F.array_join(F.transform("relations", lambda r: r.id), ","))


@query("related_files", "SELECT file_id, count(*) AS related_files_count FROM (SELECT s AS file_id FROM rels UNION ALL SELECT t FROM rels) GROUP BY 1")
def related_files(c: Corpus) -> DataFrame:
    return retrieve.relation_counts(c.relations())


@query("enrich_relations_topk", "SELECT file_id, id, other_id, k AS relation_type, w AS strength, CASE WHEN k <> 'sibling' THEN 'by ' || k END AS description, n::INT AS n FROM either WHERE n <= 2")
def enrich_relations_topk(c: Corpus) -> DataFrame:
    return retrieve.strongest(c.files().select(F.col("id").alias("file_id")), c.relations(), 2)


@query(
    "enrich_related_files",
    """SELECT e.file_id, e.other_id, e.n::INT AS n, f.path, f.summary, e.k AS relation FROM (SELECT file_id, other_id, min(n) AS n, arg_min(k, n) AS k FROM either WHERE n <= 3 GROUP BY 1, 2) e JOIN files f ON f.id = e.other_id""",
)
def enrich_related_files(c: Corpus) -> DataFrame:
    edges = retrieve.strongest(c.files().select(F.col("id").alias("file_id")), c.relations(), 3)
    return retrieve.related(edges, c.files()).drop("description")


_CHAIN = "SELECT f.id AS file_id, coalesce(summary, 'File: ' || path || '. Tags: lang-' || lang || ', ' || bank) || coalesce('|' || u, '') AS chain FROM files f LEFT JOIN (SELECT file_id, string_agg(unit, '|' ORDER BY at_) AS u FROM (SELECT file_id, unit, min(chunk_index) AS at_ FROM chunks GROUP BY 1, 2) GROUP BY 1) c ON c.file_id = f.id"


@query(
    "enrich",
    f"""SELECT p.memory_id, p.rank::INT AS rank, p.file_id, p.path, f.file_hash, l.chunk_hash, f.lang AS metadata, CASE WHEN p.path IS NOT NULL THEN coalesce(n.n, 0) END AS related_files_count, coalesce(r.r, '') AS relations, coalesce(o.o, '') AS related_files, h.chain AS chain FROM placed p
    LEFT JOIN files f ON f.id = p.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM (SELECT s AS file_id FROM rels UNION ALL SELECT t FROM rels) GROUP BY 1) n USING (file_id) LEFT JOIN ({_CHAIN}) h USING (file_id)
    LEFT JOIN (SELECT DISTINCT memory_id, chunk_hash FROM lines) l USING (memory_id)
    LEFT JOIN (SELECT file_id, string_agg(id || ' ' || k, ',' ORDER BY n) AS r FROM either WHERE n <= 5 GROUP BY 1) r USING (file_id)
    LEFT JOIN (SELECT file_id, string_agg(path || ' ' || k, ',' ORDER BY n) AS o FROM (SELECT file_id, other_id, min(n) AS n, arg_min(k, n) AS k FROM either WHERE n <= 5 GROUP BY 1, 2) e JOIN files f ON f.id = e.other_id GROUP BY 1) o USING (file_id)""",
)
def enrich(c: Corpus) -> DataFrame:
    e = F.col("file_enrichment")
    several = lambda xs, of: F.coalesce(F.array_join(F.transform(xs, of), ","), F.lit(""))
    return retrieve.enrich(_found(c), c.tables()).select(
        "memory_id", "rank", e.file.id.alias("file_id"), e.file.path.alias("path"), e.file.file_hash.alias("file_hash"), e.chunk_hash.alias("chunk_hash"), F.try_element_at(e.source_type_enrichment, F.lit("lang")).alias("metadata"), e.related_files_count.alias("related_files_count"),
        several(e.relations, lambda r: F.concat_ws(" ", r.id, r.relation_type)).alias("relations"), several(e.related_files, lambda r: F.concat_ws(" ", r.path, r.relation)).alias("related_files"), F.array_join(e.summary_chain, "|").alias("chain"),
    )


@query("summary_chain", _CHAIN)
def summary_chain(c: Corpus) -> DataFrame:
    return retrieve.summary_chain(c.files(), c.file_chunks()).select("file_id", F.array_join("chain", "|").alias("chain"))


_ONE = "SELECT s, t, arg_min(k, id) AS k, arg_min(w, id) AS w FROM rels {where} GROUP BY 1, 2"
_BODY = "SELECT file_id, string_agg(content, chr(10) ORDER BY chunk_index) AS body, count(*)::INT AS n FROM chunks JOIN memories USING (memory_id) GROUP BY 1"


@query("expand_relations", f"SELECT s AS source_file_id, t AS target_file_id, k AS relation_type, w AS strength, path, sha256(coalesce(summary, '') || (CASE WHEN summary IS NOT NULL AND body <> '' THEN chr(10) || chr(10) ELSE '' END) || coalesce(body, '')) AS content, coalesce(n, 0) AS n_chunks FROM ({_ONE.format(where='')}) o JOIN files f ON f.id = o.t LEFT JOIN ({_BODY}) b ON b.file_id = o.t")
def expand_relations(c: Corpus) -> DataFrame:
    out = retrieve.expand(c.files().select(F.col("id").alias("file_id")), c.tables(), c.memories())
    return out.withColumn("content", F.sha2("content", 256))


_KIND = "WHERE k IN ('version', 'recommendation')"


@query("expand_by_type", f"SELECT s AS source_file_id, t AS target_file_id, k AS relation_type, path, coalesce(n, 0) AS n_chunks FROM ({_ONE.format(where=_KIND)}) o JOIN files f ON f.id = o.t LEFT JOIN ({_BODY}) b ON b.file_id = o.t")
def expand_by_type(c: Corpus) -> DataFrame:
    out = retrieve.expand(c.files().select(F.col("id").alias("file_id")), c.tables(), c.memories(), ["version", "recommendation"])
    return out.select("source_file_id", "target_file_id", "relation_type", "path", "n_chunks")


@query("expand_summary_only", f"SELECT s AS source_file_id, t AS target_file_id, k AS relation_type, path, coalesce(summary, '') AS content FROM ({_ONE.format(where='')}) o JOIN files f ON f.id = o.t")
def expand_summary_only(c: Corpus) -> DataFrame:
    out = retrieve.expand(c.files().select(F.col("id").alias("file_id")), c.tables())
    return out.select("source_file_id", "target_file_id", "relation_type", "path", "content")


@query("fts_contains", f"SELECT f.id FROM files f LEFT JOIN (SELECT doc_id, string_agg(tag, ' ' ORDER BY r) AS tags FROM ({_TAGS}) GROUP BY 1) t USING (doc_id) WHERE contains(lower(path || ' ' || coalesce(t.tags, '') || ' lang-' || lang || ' ' || bank), 'the')".replace("FROM docs)", "FROM (SELECT doc_id, coalesce(text, '') AS content FROM documents))"))
def fts_contains(c: Corpus) -> DataFrame:
    return _trigrams(c).search("The")


def _trigrams(c: Corpus) -> TrigramIndex:
    return TrigramIndex(c.spark, new_folder(c.spark, "trigrams")).build(c.files())


_DOCUMENT = f"SELECT f.id, lower(concat_ws(' ', path, coalesce(t.tags, ''), 'lang-' || lang || ' ' || bank)) AS d FROM files f LEFT JOIN (SELECT doc_id, string_agg(tag, ' ' ORDER BY r) AS tags FROM ({_TAGS}) GROUP BY 1) t USING (doc_id)".replace("FROM docs)", "FROM (SELECT doc_id, coalesce(text, '') AS content FROM documents))")


@query(
    "fts_ranked",
    f"""WITH d AS ({_DOCUMENT}), g AS (SELECT id, d, greatest(length(d) - 2, 0) AS len, unnest(range(1, greatest(length(d) - 1, 1))) AS i FROM d), q AS (SELECT DISTINCT substr('lang-de', i, 3) AS gram FROM range(1, 6) t(i)),
    tf AS (SELECT id, substr(d, i::INT, 3) AS gram, count(*) AS tf FROM g WHERE substr(d, i::INT, 3) IN (SELECT gram FROM q) GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(greatest(length(d) - 2, 0)) AS mean FROM d)
    SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length(d) - 2, 0) / mean))), 6) AS score FROM tf JOIN df USING (gram) JOIN d USING (id), s WHERE contains(d, 'lang-de') GROUP BY id""",
)
def fts_ranked(c: Corpus) -> DataFrame:
    return _trigrams(c).ranked("lang-de")


# Projection


@query("remember_batch", "SELECT bank, memory_id, chunk_hash, min(seq) AS first_seq, count(*) AS repeats FROM rows_ GROUP BY 1, 2, 3")
def remember_batch(c: Corpus) -> DataFrame:
    return project.deduplicated(c.remembered())


_FILES = """SELECT id, path, coalesce(source_type, 'unknown') AS source_type, file_role, file_hash, language, total_chunks, 'indexed' AS status, tags, doc FROM (SELECT file_id AS id, any_value(path) AS path, arg_max(CASE WHEN source_type <> 'unknown' THEN source_type END, seq) AS source_type, arg_max(file_role, seq) AS file_role,
    arg_max(file_hash, seq) AS file_hash, arg_max(lang, seq) AS language, arg_max(doc_id, seq)::VARCHAR AS doc FROM rows_ GROUP BY 1) LEFT JOIN (SELECT file_id AS id, count(DISTINCT memory_id)::INT AS total_chunks FROM latest GROUP BY 1) USING (id)
    LEFT JOIN (SELECT file_id AS id, string_agg(tag, '|' ORDER BY at_) AS tags FROM (SELECT file_id, tag, min(at_) AS at_ FROM (SELECT file_id, 'lang-' || lang AS tag, seq * 2 AS at_ FROM rows_ UNION ALL SELECT file_id, bank, seq * 2 + 1 FROM rows_) GROUP BY 1, 2) GROUP BY 1) USING (id)
    UNION ALL SELECT DISTINCT target_id, target_path, 'unknown', NULL, NULL, NULL, 0, 'pending', '', NULL FROM rows_ WHERE target_id NOT IN (SELECT file_id FROM rows_)"""


@query("materialize_files", _FILES)
def materialize_files(c: Corpus) -> DataFrame:
    out = project.materialize(c.remembered())["files"]
    return out.select("id", "path", "source_type", "file_role", "file_hash", "language", "total_chunks", "status", F.array_join("tags", "|").alias("tags"), F.try_element_at("metadata", F.lit("doc")).alias("doc"))


_CHUNKS = "SELECT 'fc_' || file_id || '_' || memory_id AS id, file_id, memory_id, arg_max(chunk_index, seq)::INT AS chunk_index, (arg_max(chunk_index, seq) + 1)::INT AS start_line, arg_max(chunk_hash, seq) AS content_hash, 'doc ' || arg_max(doc_id, seq) AS unit FROM latest GROUP BY 2, 3"


@query("materialize_chunks", _CHUNKS)
def materialize_chunks(c: Corpus) -> DataFrame:
    out = project.materialize(c.remembered())["file_chunks"]
    return out.select("id", "file_id", "memory_id", "chunk_index", "start_line", "content_hash", F.col("parent_unit_summary").alias("unit"))


def _stored(c: Corpus) -> Store:
    """A store after two batches, the second one given twice: files of even numbers, then of odd ones."""
    store = Store(c.spark, new_folder(c.spark, "store"), 2)
    rows = c.remembered().withColumn("importance", F.lit(0.5))
    half = F.pmod(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"), F.lit(2))
    for n, part in ((0, half == 0), (1, half == 1), (1, half == 1)):
        store.remember(rows.filter(part), n)
    return store


@query("store_chunks", _CHUNKS)
def store_chunks(c: Corpus) -> DataFrame:
    return _stored(c).read("file_chunks").select("id", "file_id", "memory_id", "chunk_index", "start_line", "content_hash", F.col("parent_unit_summary").alias("unit"))


@query("store_files", _FILES)
def store_files(c: Corpus) -> DataFrame:
    rows = _stored(c).read("files")
    return rows.select("id", "path", "source_type", "file_role", "file_hash", "language", "total_chunks", "status", F.array_join("tags", "|").alias("tags"), F.try_element_at("metadata", F.lit("doc")).alias("doc"))


_SINCE = "SELECT file_id, min(seq) AS since FROM latest WHERE e > 0 GROUP BY 1"


@query("materialize_edges", f"SELECT DISTINCT 'fr_' || r.file_id || '_' || target_id || '_sibling' AS id, r.file_id AS source_file_id, target_id AS target_file_id, 'sibling' AS relation_type, 0.5::DOUBLE AS strength, 'next' AS description FROM rows_ r LEFT JOIN ({_SINCE}) a ON a.file_id = r.file_id LEFT JOIN ({_SINCE}) b ON b.file_id = r.target_id WHERE seq >= coalesce(a.since, seq) AND seq >= coalesce(b.since, seq)")
def materialize_edges(c: Corpus) -> DataFrame:
    return project.materialize(c.remembered())["file_relations"].drop("direction")


@query("stub_targets", "SELECT DISTINCT target_id AS id, target_path AS path FROM rows_ WHERE target_id NOT IN (SELECT file_id FROM rows_)")
def stub_targets(c: Corpus) -> DataFrame:
    rows = c.remembered().withColumn("file_id", text.file_id(F.col("bank"), F.col("path")))
    return project.stubs(rows, rows.select("file_id").distinct()).select("id", "path")


@query("rebuild_epoch", "SELECT file_id, max(epoch)::BIGINT AS epoch, count(*) AS n FROM ep GROUP BY 1")
def rebuild_epoch(c: Corpus) -> DataFrame:
    rows = project.epochs(c.remembered().withColumn("file_id", text.file_id(F.col("bank"), F.col("path"))))
    return rows.groupBy("file_id").agg(F.max("epoch").alias("epoch"), F.count("*").alias("n"))


@query("forget_cascade", "WITH g AS (SELECT memory_id FROM memories WHERE scope = 'episodic') SELECT f.id, CASE WHEN coalesce(a.n, 0) > 0 AND coalesce(l.n, 0) = 0 THEN 'deleted' ELSE 'indexed' END AS status, coalesce(l.n, 0)::INT AS total_chunks FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM chunks GROUP BY 1) a ON a.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM g) GROUP BY 1) l ON l.file_id = f.id".replace("WITH g AS (SELECT memory_id FROM memories WHERE scope = 'episodic') ", "").replace("(SELECT memory_id FROM g)", "(SELECT memory_id FROM memories WHERE scope = 'episodic')"))
def forget_cascade(c: Corpus) -> DataFrame:
    """Forgets every memory that more than one chunk shares."""
    tables = c.tables()
    tables["files"] = tables["files"].withColumn("total_chunks", F.lit(0))
    gone = c.memories().filter("scope = 'episodic'")
    return project.forget(tables, gone)["files"].select("id", "status", "total_chunks")


_OLD = "SELECT DISTINCT bank, doc_id // 40 AS file, memory_id FROM lines WHERE (doc_id // 20) % 2 = {}"


def _versions(c: Corpus) -> tuple[DataFrame, DataFrame]:
    rows = c.lines().select("bank", F.floor(F.col("doc_id") / 40).alias("file"), "memory_id", F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2)).alias("v"))
    return rows.filter("v = 0").drop("v"), rows.filter("v = 1").drop("v")


@query("stale_ids", f"SELECT * FROM ({_OLD.format(0)}) EXCEPT SELECT * FROM ({_OLD.format(1)})")
def stale_ids(c: Corpus) -> DataFrame:
    """Documents are the old or the new version of a file, by turns of 20."""
    old, new = _versions(c)
    return project.without(old.distinct(), new, ["bank", "file", "memory_id"])


@query("tracker_sync", f"SELECT coalesce(a.bank, b.bank) AS bank, coalesce(a.file, b.file) AS file, coalesce(a.memory_id, b.memory_id) AS memory_id, CASE WHEN a.bank IS NULL THEN 'add' WHEN b.bank IS NULL THEN 'remove' ELSE 'keep' END AS action FROM ({_OLD.format(0)}) a FULL JOIN ({_OLD.format(1)}) b ON a.bank = b.bank AND a.file = b.file AND a.memory_id = b.memory_id")
def tracker_sync(c: Corpus) -> DataFrame:
    return project.sync_members(*_versions(c), ["bank", "file", "memory_id"])


@query("update_memory", "SELECT bank, memory_id, CASE WHEN scope = 'episodic' THEN 0.9 ELSE 0.5 END::DOUBLE AS importance FROM memories")
def update_memory(c: Corpus) -> DataFrame:
    rows = c.memories()
    updates = rows.filter("scope = 'episodic'").select("bank", "memory_id", F.lit(0.9).alias("importance"))
    return project.patch(rows.select("bank", "memory_id", "importance"), updates, ["bank", "memory_id"])


@query("update_file", "SELECT id, CASE WHEN n > 3 THEN 'docs' ELSE file_role END AS file_role FROM files LEFT JOIN (SELECT file_id AS id, count(*) AS n FROM chunks GROUP BY 1) USING (id)")
def update_file(c: Corpus) -> DataFrame:
    long = c.file_chunks().groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 3")
    return project.patch(c.files().select("id", "file_role"), long.select("id", F.lit("docs").alias("file_role")), ["id"])


@query("upsert_changes", f"SELECT bank, file, CASE WHEN a IS NULL THEN 'insert' WHEN b IS NULL THEN 'delete' WHEN a <> b THEN 'update' ELSE 'none' END AS change FROM (SELECT bank, doc_id // 40 AS file, content AS a FROM docs WHERE (doc_id // 20) % 2 = 0) FULL JOIN (SELECT bank, doc_id // 40 AS file, content AS b FROM docs WHERE (doc_id // 20) % 2 = 1) USING (bank, file)")
def upsert_changes(c: Corpus) -> DataFrame:
    docs = c.documents().select("bank", F.floor(F.col("doc_id") / 40).alias("file"), "content", F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2)).alias("v"))
    return project.changes(docs.filter("v = 0").drop("v"), docs.filter("v = 1").drop("v"), ["bank", "file"])


_NEXT = "SELECT id FROM files WHERE doc_id % 11 = 0 UNION ALL SELECT 'file_none'"


def _some_files(c: Corpus) -> DataFrame:
    own = c.files().filter(F.pmod("doc_id", F.lit(11)) == 0).select(F.col("id").alias("file_id"))
    return own.union(c.spark.sql("SELECT 'file_none' AS file_id"))


@query(
    "get_file",
    f"""SELECT a.id AS file_id, CASE WHEN f.id IS NULL THEN 'FILE_NOT_FOUND' ELSE 'found' END AS status, f.path, coalesce(c.c, '') AS chunks, coalesce(r.r, '') AS relations FROM ({_NEXT}) a LEFT JOIN files f ON f.id = a.id LEFT JOIN (SELECT file_id, string_agg(memory_id, ',' ORDER BY chunk_index, memory_id) AS c FROM chunks GROUP BY 1) c ON c.file_id = a.id
    LEFT JOIN (SELECT e, string_agg(id, ',' ORDER BY id) AS r FROM (SELECT id, k, s AS e FROM rels UNION ALL SELECT id, k, t FROM rels) WHERE k IN ('version', 'sibling') GROUP BY 1) r ON r.e = a.id""",
)
def get_file(c: Corpus) -> DataFrame:
    out = lifecycle.get_files(c.tables(), _some_files(c), ["version", "sibling"])
    return out.select("file_id", "status", "file.path", F.array_join("chunks", ",").alias("chunks"), F.array_join("relations", ",").alias("relations"))


@query("files_by_created", "SELECT id, path, epoch(make_timestamp((1700000000 + doc_id * 7919 % 1000003) * 1000000))::BIGINT AS created FROM files ORDER BY created DESC, path LIMIT 100")
def files_by_created(c: Corpus) -> DataFrame:
    """A top-k report: the hundred newest files."""
    return lifecycle.files_by_age(c.files(), 100).select("id", "path", F.unix_timestamp("created_at").alias("created"))


@query("relations_by_pair", "SELECT id, s AS source_file_id, t AS target_file_id, k AS relation_type FROM rels WHERE EXISTS (SELECT 1 FROM files a JOIN files b ON b.doc_id = a.doc_id + 20 WHERE a.id = s AND b.id = t)")
def relations_by_pair(c: Corpus) -> DataFrame:
    to = c.files().select(F.col("id").alias("target_file_id"), (F.col("doc_id") - 20).alias("doc_id"))
    pairs = c.files().select(F.col("id").alias("source_file_id"), "doc_id").join(to, "doc_id")
    return lifecycle.relations_between(c.relations(), pairs).select("id", "source_file_id", "target_file_id", "relation_type")


@query(
    "remove_chunk",
    f"""WITH w AS (SELECT a.id AS file_id, m.memory_id FROM ({_NEXT}) a JOIN (SELECT memory_id FROM memories WHERE scope = 'episodic') m ON true)
    SELECT file_id, memory_id, CASE WHEN file_id = 'file_none' THEN 'FILE_NOT_FOUND' WHEN EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = w.file_id AND c.memory_id = w.memory_id) THEN 'removed' ELSE 'CHUNK_NOT_FOUND' END AS status FROM w WHERE memory_id IN (SELECT memory_id FROM memories WHERE scope = 'episodic' ORDER BY memory_id LIMIT 5)""",
)
def remove_chunk(c: Corpus) -> DataFrame:
    """The five first shared memories, asked of each of some files."""
    five = c.memories().filter("scope = 'episodic'").orderBy("memory_id").limit(5).select("memory_id")
    asked = _some_files(c).join(F.broadcast(five.withColumn("__k", F.lit(1))), F.col("__k") == 1).drop("__k")
    return lifecycle.remove_chunks(c.tables(), asked)[0]


@query(
    "rebuild_projection",
    f"SELECT (SELECT count(*) FROM chunks) - (SELECT count(*) FROM chunks WHERE file_id IN ({_NEXT}) AND chunk_index % 2 = 1) AS chunks, (SELECT count(*) FROM rels WHERE s NOT IN ({_NEXT}) AND t NOT IN ({_NEXT})) AS relations",
)
def rebuild_projection(c: Corpus) -> DataFrame:
    """Some files keep the chunks of even index; what is left is counted."""
    keep = c.file_chunks().filter(F.pmod("chunk_index", F.lit(2)) == 0)
    out = lifecycle.rebuilt(c.tables(), _some_files(c), keep)
    rows = out["file_chunks"].select(F.lit(1).alias("c"), F.lit(0).alias("r")).union(out["file_relations"].select(F.lit(0), F.lit(1)))
    return rows.agg(F.sum("c").cast("long").alias("chunks"), F.sum("r").cast("long").alias("relations"))


_KINDS = "(VALUES ('src0', 'pure_memories'), ('src1', 'files')) b(bank, bank_type)"


@query(
    "forget_memories",
    f"""SELECT a.bank, a.memory_id, CASE WHEN coalesce(b.bank_type, '') <> 'pure_memories' THEN 'MEMORY_BANK_NOT_SUPPORTED' WHEN a.real THEN 'deleted' ELSE 'not_found' END AS status FROM (SELECT bank, memory_id, true AS real FROM memories WHERE scope = 'episodic' UNION ALL SELECT DISTINCT bank, 'mem_none', false FROM memories) a LEFT JOIN {_KINDS} ON b.bank = a.bank""",
)
def forget_memories(c: Corpus) -> DataFrame:
    return _forgotten(c)[0]


def _forgotten(c: Corpus) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    banks = c.spark.sql("SELECT * FROM VALUES ('src0', 'pure_memories'), ('src1', 'files') AS t(bank, bank_type)")
    rows = c.memories().select("bank", "memory_id", "scope")
    asked = rows.filter("scope = 'episodic'").select("bank", "memory_id").union(rows.select("bank", F.lit("mem_none")).distinct())
    return lifecycle.forget(rows, c.tables() | {"files": c.files().withColumn("total_chunks", F.lit(0))}, asked, banks)


@query("forget_memories_left", "SELECT bank, count(*) AS n FROM memories WHERE NOT (bank = 'src0' AND scope = 'episodic') GROUP BY 1")
def forget_memories_left(c: Corpus) -> DataFrame:
    return _forgotten(c)[1].groupBy("bank").agg(F.count("*").alias("n"))


@query(
    "chunk_decisions",
    "SELECT file_id, memory_id, CASE WHEN chunk_index % 4 = 0 THEN 'insert' WHEN chunk_index % 4 = 1 THEN 'replace' WHEN chunk_index % 4 = 2 THEN 'update' ELSE 'none' END AS decision FROM chunks",
)
def chunk_decisions(c: Corpus) -> DataFrame:
    """By index modulo four: a chunk that was not there, one from another place, one with another end, one as it was."""
    new, k = c.file_chunks(), F.pmod("chunk_index", F.lit(4))
    old = new.filter(k != 0).select("file_id", "memory_id", F.when(k == 1, F.col("chunk_index") + 5).otherwise(F.col("chunk_index")).alias("chunk_index"), "start_line", F.when(k == 2, F.col("end_line") + 1).otherwise(F.col("end_line")).alias("end_line"), "content_hash", F.lit("old").alias("section_header"), "parent_unit_summary")
    return lifecycle.chunk_decisions(old, new.withColumn("section_header", F.lit(None).cast("string")))


@query(
    "relation_decisions",
    "SELECT CASE WHEN substr(sha256(id), 1, 1) < '4' THEN t ELSE s END AS file_id, s AS source_file_id, t AS target_file_id, k AS relation_type, CASE WHEN substr(sha256(id), 1, 1) < '4' THEN 'RELATION_SOURCE_MISMATCH' WHEN k = 'recommendation' THEN 'insert' WHEN k = 'sibling' THEN 'update' ELSE 'none' END AS decision FROM rels",
)
def relation_decisions(c: Corpus) -> DataFrame:
    """Recommendations are new, siblings lose their description, versions stay; a quarter is asked of the wrong file."""
    new = c.relations()
    old = new.filter("relation_type <> 'recommendation'").withColumn("description", F.coalesce("description", F.lit("next")))
    own = F.when(F.substring(F.sha2("id", 256), 1, 1) < "4", F.col("target_file_id")).otherwise(F.col("source_file_id"))
    return lifecycle.relation_decisions(old, new.withColumn("file_id", own))


@query(
    "file_states",
    "SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'archived' ELSE 'indexed' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'changed' ELSE 'already' END AS outcome FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT 'file_none', 'archived', 'not_found'",
)
def file_states(c: Corpus) -> DataFrame:
    rows = c.files().select("id", "status", "doc_id")
    asked = rows.filter(F.pmod("doc_id", F.lit(3)) == 0).select("id", F.when(F.pmod("doc_id", F.lit(2)) == 0, "archived").otherwise("indexed").alias("status"))
    return lifecycle.transitions(rows, asked.union(c.spark.sql("SELECT 'file_none' AS id, 'archived' AS status")), "id")[0]


@query("memory_states", "SELECT memory_id, CASE WHEN scope = 'episodic' THEN 'suspended' ELSE 'active' END AS status FROM (SELECT memory_id, min(scope) AS scope FROM memories GROUP BY 1)")
def memory_states(c: Corpus) -> DataFrame:
    """Shared memories suspended."""
    rows = c.memories().select("memory_id", F.lit("active").alias("status"), "scope")
    return lifecycle.transitions(rows, rows.filter("scope = 'episodic'").select("memory_id", F.lit("suspended").alias("status")), "memory_id")[1].drop("scope")


@query("relation_ids", "SELECT DISTINCT 'fr_' || s || '_' || t || '_' || k AS id, w AS strength FROM rels")
def relation_ids(c: Corpus) -> DataFrame:
    """Relations under an old id converge with those under their own."""
    rows = c.relations()
    old = rows.filter("relation_type <> 'version'").withColumn("id", F.concat_ws("_", F.lit("fr"), "source_file_id", "target_file_id")).withColumn("strength", F.lit(0.1))
    return lifecycle.converged(rows.unionByName(old)).select("id", "strength")


@query("tracker_update", "SELECT path, CASE WHEN doc_id % 2 = 0 THEN sha256(path) ELSE file_hash END AS file_hash FROM files WHERE doc_id % 5 <> 0")
def tracker_update(c: Corpus) -> DataFrame:
    rows = c.files().select("path", "file_hash", "doc_id")
    hashes = rows.filter(F.pmod("doc_id", F.lit(2)) == 0).select("path", F.sha2("path", 256).alias("file_hash"))
    return lifecycle.tracked(rows, hashes, rows.filter(F.pmod("doc_id", F.lit(5)) == 0).select("path")).drop("doc_id")


@query("bank_states", "SELECT bank, CASE WHEN bank = 'src0' THEN 'suspended' ELSE 'active' END AS status FROM (SELECT DISTINCT bank FROM memories)")
def bank_states(c: Corpus) -> DataFrame:
    rows = c.memories().select("bank").distinct().withColumn("status", F.lit("active"))
    return lifecycle.transitions(rows, c.spark.sql("SELECT * FROM VALUES ('src0', 'suspended'), ('none at all', 'suspended') AS t(bank, status)"), "bank")[1]


@query(
    "bank_register",
    """SELECT coalesce(r.bank, b.bank) AS bank, coalesce(r.description, b.description) AS description, coalesce(b.status, 'active') AS status, CASE WHEN r.bank IS NULL THEN NULL WHEN b.bank IS NULL THEN 'registered' ELSE 'exists' END AS outcome
    FROM (SELECT DISTINCT bank, 'about ' || bank AS description, 'active' AS status FROM memories) b FULL JOIN (SELECT bank, max(description) AS description FROM (VALUES ('src0', 'again'), ('src1', NULL), ('fresh', 'new'), ('fresh', 'newer')) v(bank, description) GROUP BY 1) r ON b.bank = r.bank""",
)
def bank_register(c: Corpus) -> DataFrame:
    """Known banks and a new one registered: descriptions are replaced."""
    banks = c.memories().select("bank").distinct().select("bank", F.concat(F.lit("about "), "bank").alias("description"), F.lit("active").alias("status"))
    return lifecycle.register(banks, c.spark.sql("SELECT * FROM VALUES ('src0', 'again'), ('src1', NULL), ('fresh', 'new'), ('fresh', 'newer') AS t(bank, description)"))


@query(
    "bank_counts",
    """WITH RECURSIVE steps AS (SELECT source AS bank, doc_id AS seq, CASE WHEN doc_id % 5 < 2 THEN 1 ELSE -1 END AS d FROM documents WHERE source IS NOT NULL),
    b AS (SELECT DISTINCT source AS bank, CASE WHEN source = 'src0' THEN 'suspended' ELSE 'active' END AS status, 3 AS c0 FROM documents WHERE source IS NOT NULL),
    o AS (SELECT bank, CASE WHEN d = 1 AND status <> 'active' THEN 0 ELSE d END AS d, (d = 1 AND status <> 'active')::INT AS no, row_number() OVER (PARTITION BY bank ORDER BY seq) AS k FROM steps JOIN b USING (bank)),
    w AS (SELECT bank, c0 AS c, 0 AS k FROM b UNION ALL SELECT w.bank, greatest(0, w.c + o.d), o.k FROM w JOIN o ON o.bank = w.bank AND o.k = w.k + 1)
    SELECT bank, arg_max(c, k)::BIGINT AS memory_count, (SELECT sum(no) FROM o WHERE o.bank = w.bank)::BIGINT AS rejected FROM w GROUP BY bank""",
)
def bank_counts(c: Corpus) -> DataFrame:
    """Two documents of five remembered, three forgotten, from a count of three; one bank is suspended."""
    docs = c.table("documents").filter("source is not null")
    banks = docs.select(F.col("source").alias("bank")).distinct().select("bank", F.when(F.col("bank") == "src0", "suspended").otherwise("active").alias("status"), F.lit(3).alias("memory_count"))
    steps = docs.select(F.col("source").alias("bank"), F.col("doc_id").alias("seq"), F.when(F.pmod("doc_id", F.lit(5)) < 2, "remember").otherwise("forget").alias("kind"))
    return lifecycle.bank_counts(banks, steps, 64)


@query("delete_file", "SELECT id AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'FILE_ALREADY_DELETED' ELSE 'deleted' END AS outcome FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT 'file_none', 'FILE_NOT_FOUND'")
def delete_file(c: Corpus) -> DataFrame:
    """Every second file and an absent one; every fourth is a tombstone already."""
    tables = c.tables()
    n = F.col("doc_id")
    tables["files"] = tables["files"].withColumn("status", F.when(F.pmod(n, F.lit(4)) == 0, "deleted").otherwise(F.col("status")))
    asked = tables["files"].filter(F.pmod(n, F.lit(2)) == 0).select(F.col("id").alias("file_id"))
    return lifecycle.delete_files(tables, asked.union(c.spark.sql("SELECT 'file_none' AS file_id")))[0]


@query(
    "update_file_outcomes",
    """SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'FILE_DELETED' WHEN file_role = 'docs' THEN 'none' ELSE 'updated' END AS outcome, CASE WHEN doc_id % 4 <> 0 THEN 'docs' ELSE file_role END AS file_role FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT 'file_none', 'FILE_NOT_FOUND', NULL""",
)
def update_file_outcomes(c: Corpus) -> DataFrame:
    """Every third file and an absent one called documentation; every fourth is a tombstone."""
    files = c.files().withColumn("status", F.when(F.pmod("doc_id", F.lit(4)) == 0, "deleted").otherwise(F.col("status"))).select("id", "doc_id", "status", "file_role")
    asked = files.filter(F.pmod("doc_id", F.lit(3)) == 0).select("id", F.lit("docs").alias("file_role"))
    out, after = lifecycle.update_files(files, asked.union(c.spark.sql("SELECT 'file_none' AS id, 'docs' AS file_role")))
    return out.join(after.select("id", "file_role"), "id", "left")


@query("bank_list", "SELECT coalesce(b.bank, m.bank) AS bank, description, coalesce(n, 0) AS n_memories FROM (VALUES ('src0', 'first'), ('spare', 'unused')) b(bank, description) FULL JOIN (SELECT bank, count(*) AS n FROM memories GROUP BY 1) m ON b.bank = m.bank")
def bank_list(c: Corpus) -> DataFrame:
    banks = c.spark.sql("SELECT * FROM VALUES ('src0', 'first'), ('spare', 'unused') AS t(bank, description)")
    return retrieve.bank_list(banks, c.memories())


@query("bank_stats", "SELECT bank, count(*) AS total, count(*) FILTER (scope = 'working') AS working, count(*) FILTER (scope = 'episodic') AS episodic, avg(importance) AS mean_importance FROM memories GROUP BY 1")
def bank_stats(c: Corpus) -> DataFrame:
    return retrieve.bank_stats(c.memories())


@query("consolidate", r"SELECT bank, sha256(trim(regexp_replace(lower(content), '[\s\x0B]+', ' ', 'g'))) AS content_key, min(memory_id) AS memory_id, max(importance) AS importance, count(*) AS merged FROM memories GROUP BY 1, 2")
def consolidate(c: Corpus) -> DataFrame:
    return project.consolidate(c.memories())


# Links


@query("backlink_edges", "SELECT path AS source_path, '/' || bank || '/' || link || '.md' AS target_path, 'backlink' AS relation_type, 1.0::DOUBLE AS strength FROM note_links")
def backlink_edges(c: Corpus) -> DataFrame:
    return links.backlinks(c.notes(), c.notes())


@query("see_also_edges", "SELECT a.path AS source_path, b.path AS target_path, 'recommendation' AS relation_type, 1.0::DOUBLE AS strength FROM notes a JOIN notes b ON b.bank = a.bank AND b.doc_id = a.doc_id * 2 WHERE a.doc_id <> b.doc_id")
def see_also_edges(c: Corpus) -> DataFrame:
    return links.see_also(c.notes(), c.notes(), F.array(text.front_value(text.frontmatter(F.col("content")), "see_also")))


@query("vault_ladder", "SELECT DISTINCT path AS source_path, target AS target_path, 'backlink' AS relation_type, 1.0::DOUBLE AS strength FROM (SELECT path, target FROM rungs UNION SELECT path, target FROM alone)")
def vault_ladder(c: Corpus) -> DataFrame:
    return links.vault_links(*c.vault())


@query("companion_edges", "SELECT a.path AS source_path, b.path AS target_path, CASE WHEN b.path LIKE '%/session.md' THEN 'parent_child' ELSE 'sibling' END AS relation_type, 1.0::DOUBLE AS strength FROM sess a JOIN sess b USING (conv_id) WHERE a.path <> b.path AND b.path NOT LIKE '%/turns/%' AND EXISTS (SELECT 1 FROM sess s WHERE s.path = a.root || '/session.md')")
def companion_edges(c: Corpus) -> DataFrame:
    return links.companions(links.session_roots(c.sessions()))


@query(
    "xref_edges",
    r"""SELECT DISTINCT a.path AS source_path, b.path AS target_path, 'cross_reference' AS relation_type, 0.7::DOUBLE AS strength FROM sess a JOIN sess b USING (conv_id) WHERE a.path <> b.path AND EXISTS (SELECT 1 FROM sess s WHERE s.path = a.root || '/session.md') AND (
    list_contains(regexp_extract_all(a.content, '[\w./~-]+\.[A-Za-z][A-Za-z0-9]*\b'), substr(b.path, length(b.root) + 2)) OR regexp_matches(a.content, '(^|[^\w./-])' || replace(regexp_extract(b.path, '[^/]+$'), '.', '\.') || '($|\W)'))""",
)
def xref_edges(c: Corpus) -> DataFrame:
    return links.references(links.session_roots(c.sessions()))


@query(
    "session_walk",
    """SELECT root, path FROM (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY string_split(substr(path, length(root) + 2), '/')) AS n FROM (SELECT DISTINCT '/s' || (doc_id // 400) AS root,
      '/s' || (doc_id // 400) || (CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/m' WHEN 2 THEN '/m/a' WHEN 3 THEN '/k.d/x/y' ELSE '/z/1/2/3' END) || '/f' || doc_id || '.md' AS path, doc_id % 5 AS k FROM documents WHERE doc_id IS NOT NULL) WHERE k <> 4) WHERE n <= 200""",
)
def session_walk(c: Corpus) -> DataFrame:
    """Sessions of up to 400 files in folders of one to five levels: what a walk of four levels and 200 files meets."""
    n = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("", "/m", "/m/a", "/k.d/x/y", "/z/1/2/3")]), (F.pmod(n, F.lit(5)) + 1).cast("int"))
    root = F.concat(F.lit("/s"), F.floor(n / 400).cast("string"))
    files = c.table("documents").filter("doc_id is not null").select(root.alias("root"), F.concat(root, folder, F.lit("/f"), n.cast("string"), F.lit(".md")).alias("path")).distinct()
    return bounded_walk(files, 4, 200, deep_first=True).select("root", "path")


@query("html_link_edges", """SELECT DISTINCT page_id, x AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"''>]*)["'']', 1)) AS x FROM pages)""")
def html_link_edges(c: Corpus) -> DataFrame:
    return links.html_links(c.table("pages").select("page_id", "html"))


# Evaluation


def _golden(c: Corpus) -> DataFrame:
    items = c.table("benchmark").select("item_id", "text")
    docs = c.documents().select(F.col("doc_id").alias("memory_id"), "content")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    folder = new_folder(c.spark, "golden")  # both sides are asked several times
    relevant, got = written(evaluate.containing(docs, items), f"{folder}/relevant"), written(retrieve.recall(docs, asked, 5, 3), f"{folder}/got")
    return evaluate.golden(relevant, got, asked.select("query_id").distinct())


@query("golden_recall5", "SELECT query_id, round(CASE WHEN n_relevant > 0 THEN hits / n_relevant ELSE 0 END, 6)::DOUBLE AS recall FROM golden")
def golden_recall5(c: Corpus) -> DataFrame:
    return _golden(c).select("query_id", F.round("recall", 6).alias("recall"))


@query("golden_precision5", "SELECT query_id, round(CASE WHEN n_got > 0 THEN hits / 5 ELSE 0 END, 6)::DOUBLE AS precision FROM golden")
def golden_precision5(c: Corpus) -> DataFrame:
    return _golden(c).select("query_id", F.round("precision", 6).alias("precision"))


@query("golden_mrr", "SELECT query_id, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr FROM golden")
def golden_mrr(c: Corpus) -> DataFrame:
    return _golden(c).select("query_id", F.round("mrr", 6).alias("mrr"))


@query("golden_gate", "SELECT a AS mrr, b AS baseline_mrr, a - b < -0.1 AS blocking FROM (SELECT round(coalesce(avg(m) FILTER (query_id % 2 = 1), 0), 6)::DOUBLE AS a, round(coalesce(avg(m) FILTER (query_id % 2 = 0), 0), 6)::DOUBLE AS b FROM (SELECT query_id, coalesce(1.0 / first, 0) AS m FROM golden))")
def golden_gate(c: Corpus) -> DataFrame:
    """Items of odd numbers against those of even ones."""
    scores, odd = _golden(c), F.pmod("query_id", F.lit(2)) == 1
    return evaluate.gate(evaluate.averaged(scores.filter(odd)), evaluate.averaged(scores.filter(~odd)).select("mrr"))


@query("golden_report", "SELECT count(*) AS queries, round(avg(CASE WHEN n_relevant > 0 THEN hits / n_relevant ELSE 0 END), 6)::DOUBLE AS recall, round(avg(CASE WHEN n_got > 0 THEN hits / 5 ELSE 0 END), 6)::DOUBLE AS precision, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr FROM golden")
def golden_report(c: Corpus) -> DataFrame:
    return evaluate.averaged(_golden(c))


@query(
    "golden_runner",
    r"""WITH n AS (SELECT item_id, trim(regexp_replace(lower(e), '[\s\x0B]+', ' ', 'g')) AS e FROM (SELECT item_id, text AS e FROM benchmark UNION ALL SELECT item_id, array_to_string(string_split(text, ' ')[1:5], ' ') FROM benchmark)),
    h AS (SELECT item_id, count(*) AS hits, min(rank) AS first FROM (SELECT DISTINCT g.item_id, g.rank FROM got g JOIN docs d USING (doc_id) JOIN n ON n.item_id = g.item_id AND n.e <> '' AND contains(trim(regexp_replace(lower(d.content), '[\s\x0B]+', ' ', 'g')), n.e)) GROUP BY 1)
    SELECT b.item_id AS query_id, 'kind ' || (b.item_id % 4) AS content_type, 2::BIGINT AS relevant_count, coalesce(h.hits, 0)::BIGINT AS hits, coalesce(g.n, 0)::BIGINT AS retrieved_count, round(coalesce(h.hits, 0) / 2, 6)::DOUBLE AS recall, round(coalesce(h.hits, 0) / 5, 6)::DOUBLE AS precision, round(coalesce(1.0 / h.first, 0), 6)::DOUBLE AS mrr
    FROM benchmark b LEFT JOIN h USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM got GROUP BY 1) g USING (item_id)""",
)
def golden_runner(c: Corpus) -> DataFrame:
    """Each item and its first five words as expected contents, held against the five best documents."""
    items = c.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = c.documents().select(F.col("doc_id").alias("memory_id"), "content")
    got = written(retrieve.recall(docs, items.select("query_id", F.col("text").alias("query")), 5, 3), new_folder(c.spark, "golden"))
    expected = items.select("query_id", F.col("text").alias("content")).union(items.select("query_id", F.substring_index("text", " ", 5)))
    queries = items.select("query_id", F.concat(F.lit("kind "), F.pmod("query_id", F.lit(4)).cast("string")).alias("content_type"))
    out = evaluate.by_contents(queries, expected, got.join(docs, "memory_id").select("query_id", "rank", "content"))
    return out.select("query_id", "content_type", "relevant_count", "hits", "retrieved_count", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "mrr")])


@query(
    "golden_report_lines",
    """SELECT kind, line FROM (SELECT 'query' AS kind, '{"mode":"check","query_id":' || query_id || ',"recall":' || r || ',"precision":' || p || ',"mrr":' || m || '}' AS line FROM (SELECT query_id, round(CASE WHEN n_relevant > 0 THEN hits / n_relevant ELSE 0 END, 6)::DOUBLE AS r, round(CASE WHEN n_got > 0 THEN hits / 5 ELSE 0 END, 6)::DOUBLE AS p, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS m FROM golden))
    UNION ALL SELECT 'mean', '{"mode":"check","queries":' || q || ',"recall":' || r || ',"precision":' || p || ',"mrr":' || m || ',"blocking":' || (CASE WHEN m < 0.5 - 0.1 THEN 'true' ELSE 'false' END) || '}' FROM (SELECT count(*) AS q, round(avg(round(CASE WHEN n_relevant > 0 THEN hits / n_relevant ELSE 0 END, 6)), 6)::DOUBLE AS r, round(avg(round(CASE WHEN n_got > 0 THEN hits / 5 ELSE 0 END, 6)), 6)::DOUBLE AS p, round(avg(round(coalesce(1.0 / first, 0), 6)), 6)::DOUBLE AS m FROM golden)""",
)
def golden_report_lines(c: Corpus) -> DataFrame:
    """The report itself, with a baseline of one half."""
    scores = _golden(c).select("query_id", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "mrr")])
    return evaluate.report(scores, "check", 0.5)


# Events


@query(
    "event_debounce",
    """SELECT path, arg_max(op, o) AS op, max(ts) AS ts, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts, op) AS g, row_number() OVER (PARTITION BY path ORDER BY ts, op) AS o FROM (
    SELECT user_id::VARCHAR AS path, event_type AS op, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY path, g""",
)
def event_debounce(c: Corpus) -> DataFrame:
    return events.settled(c.events(), "1 hour")


@query(
    "event_inflight_dedup",
    """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS path, ts, min(event_type) AS op FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT path, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT path, nxt FROM (SELECT f.path, (SELECT min(e.ts) FROM e WHERE e.path = f.path AND e.ts >= f.ts + INTERVAL 1 HOUR) AS nxt FROM f) WHERE nxt IS NOT NULL)
    SELECT path, op, ts FROM f JOIN e USING (path, ts)""",
)
def event_inflight_dedup(c: Corpus) -> DataFrame:
    return events.in_flight_once(c.events(), "1 hour")


_OPS = "CASE WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'add' ELSE 'change' END"


@query(
    "event_actions",
    f"""WITH x AS (SELECT user_id::VARCHAR AS path, {_OPS} AS op, ts, 'm' || (event_id % 7) AS m, event_id % 2 AS half FROM events WHERE user_id IS NOT NULL),
    l AS (SELECT path, arg_max(op, row(ts, op)) AS op FROM x WHERE half = 1 GROUP BY 1),
    a AS (SELECT DISTINCT x.path, m FROM x JOIN l USING (path) WHERE half = 0), b AS (SELECT DISTINCT x.path, m FROM x JOIN l USING (path) WHERE half = 1 AND l.op <> 'delete')
    SELECT coalesce(a.path, b.path) AS path, coalesce(a.m, b.m) AS memory_id, CASE WHEN a.path IS NULL THEN 'remember' WHEN b.path IS NULL THEN 'forget' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.path = b.path AND a.m = b.m""",
)
def event_actions(c: Corpus) -> DataFrame:
    """Every second event changes what the others left: memories to remember, keep and forget."""
    n = F.col("event_id")
    rows = c.table("events").filter("user_id is not null").select(F.col("user_id").cast("string").alias("path"), F.when(n % 11 == 0, "delete").when(n % 3 == 0, "add").otherwise("change").alias("op"), "ts", F.concat(F.lit("m"), (n % 7).cast("string")).alias("memory_id"), (n % 2).alias("half"))
    return events.plan(rows.filter("half = 1").select("path", "op", "ts"), rows.filter("half = 0").select("path", "memory_id"), rows.filter("half = 1").select("path", "memory_id"))


@query("folder_changes", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'change' END AS op FROM (SELECT path, sha256(content) AS h FROM docs WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT path, CASE WHEN doc_id % 4 = 0 THEN sha256(path) ELSE sha256(content) END AS h FROM docs WHERE doc_id % 5 <> 0) b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h")
def folder_changes(c: Corpus) -> DataFrame:
    """Two listings of the documents' files, some only in one, some with another hash."""
    docs, n = c.documents(), F.col("doc_id")
    before = docs.filter(F.pmod(n, F.lit(3)) != 0).select("path", F.sha2("content", 256).alias("file_hash"))
    after = docs.filter(F.pmod(n, F.lit(5)) != 0).select("path", F.when(F.pmod(n, F.lit(4)) == 0, F.sha2("path", 256)).otherwise(F.sha2("content", 256)).alias("file_hash"))
    return listing_changes(before, after)
