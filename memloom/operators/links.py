"""Typed edges between files: wiki links, recommendations, companions, references in text.

A catalogue is the table of existing files, ``(root, path)``. Targets are looked up in it by
equality: every rule first writes down the paths or names that could be meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import classify, text
from memloom.sources.files import bounded_walk

#: Fixed values.
COMPANIONS = ["session.md", "specifications/spec.md", "findings/findings.md", "decisions/decisions.md", "plans/implementation-plan.md"]
XREF_STRENGTH = 0.7


def under(folder: Column, name: Column) -> Column:
    """``name`` below ``folder``, with ``.`` and ``..`` steps resolved and absolute names kept."""
    joined = F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", folder, name))
    none = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/"), none, step), "/"))


def edge(kind: str, strength: float = 1.0) -> list[Column]:
    return [F.col("path").alias("source_path"), F.col("target").alias("target_path"), F.lit(kind).alias("relation_type"), F.lit(strength).alias("strength")]


def linked(notes: DataFrame) -> DataFrame:
    """``(root, path, link)``: one row for each distinct wiki link of a note's body."""
    return notes.select("root", "path", F.explode(text.wikilinks(text.body(F.col("content")))).alias("link"))


def backlinks(notes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Edges of wiki links in ``notes(root, path, content)``: a name with an extension must exist, another becomes a ``.md`` file."""
    return backlinks_of(linked(notes), catalogue)


def backlinks_of(named: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``backlinks`` of links that were found before, ``named(root, path, link)``."""
    named = named.withColumn("exact", F.substring_index("link", "/", -1).contains("."))
    named = named.withColumn("target", under(F.col("root"), F.when(F.col("exact"), F.col("link")).otherwise(F.concat("link", F.lit(".md")))))
    there = catalogue.select(F.col("path").alias("target")).distinct()
    found = named.filter("exact").join(there, "target", "left_semi").unionByName(named.filter("not exact"))
    return found.filter("target <> path").select(*edge("backlink")).distinct()


def see_also(notes: DataFrame, catalogue: DataFrame, values: Column) -> DataFrame:
    """Recommendation edges to the files the array ``values`` names, as they stand or with ``.md``."""
    named = notes.select("root", "path", F.posexplode(values).alias("n", "link")).filter(F.trim("link") != "")
    tried = named.select("path", "n", F.posexplode(F.array(under(F.col("root"), F.col("link")), under(F.col("root"), F.concat("link", F.lit(".md"))))).alias("rank", "target"))
    there = catalogue.select(F.col("path").alias("target")).distinct()
    best = tried.join(there, "target", "left_semi").groupBy("path", "n").agg(F.min_by("target", "rank").alias("target"))
    return best.filter("target <> path").select(*edge("recommendation")).distinct()


def vault_links(notes: DataFrame, catalogue: DataFrame, depth: int = 6, files: int = 500) -> DataFrame:
    """Backlink edges of a vault; a link that nothing fits goes. A note is never its own target, at no rung.

    A link with a folder names a file below the root, as it stands if it has an extension, else or failing that with
    ``.md``. A bare name is tried with ``.md`` at the root, then in the note's own folder, then as it stands at
    both. At last it is the one other file of that name, of that stem, or of a stem that goes on after a
    dot, among the ``files`` first of a walk ``depth`` folders deep (five below the root), shallow first, then by path.
    """
    return vault_links_of(linked(notes), catalogue, depth, files)


def vault_links_of(named: DataFrame, catalogue: DataFrame, depth: int = 6, files: int = 500) -> DataFrame:
    """``vault_links`` of links that were found before, ``named(root, path, link)``."""
    root, own, link = F.col("root"), classify.directory(F.col("path")), F.col("link")
    with_md = F.when(link.endswith(".md"), link).otherwise(F.concat(link, F.lit(".md")))
    as_path = F.array(F.when(link.rlike(r"[^/]\.[^/]*$"), under(root, link)), under(root, with_md))
    bare = F.array(under(root, with_md), under(own, with_md), under(root, link), under(own, link))
    tried = named.select("root", "path", "link", F.posexplode(F.when(link.contains("/"), as_path).otherwise(bare)).alias("rank", "target"))
    tried = tried.filter("target is not null and target <> path")
    there = catalogue.select(F.col("path").alias("target")).distinct()
    direct = tried.join(there, "target", "left_semi").groupBy("root", "path", "link").agg(F.min_by("target", "rank").alias("target"))
    left = named.filter(~link.contains("/")).join(direct, ["root", "path", "link"], "left_anti")
    name, bare_name = classify.basename(F.col("path")), classify.stem(F.col("path"))
    dots = F.split(bare_name, r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, 1, i), "."))
    seen = bounded_walk(catalogue.select("root", "path").distinct(), depth, files)
    names = seen.select("root", F.col("path").alias("target"), F.explode(F.array_distinct(F.concat(F.array(name), starts))).alias("link"))
    counted = names.groupBy("root", "link").agg(F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high")).filter("n <= 2")
    one = left.join(counted, ["root", "link"]).join(names.select("root", "link", F.col("target").alias("path"), F.lit(1).alias("self")), ["root", "link", "path"], "left")
    one = one.filter(F.col("n") - F.coalesce("self", F.lit(0)) == 1)
    one = one.select("path", F.when(F.col("low") == F.col("path"), F.col("high")).otherwise(F.col("low")).alias("target"))
    return direct.select("path", "target").unionByName(one).select(*edge("backlink")).distinct()


def session_roots(files: DataFrame) -> DataFrame:
    """``files(path)`` with ``session_root``: the nearest folder above that holds ``session.md``, else the own folder."""
    parts = F.split(classify.directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = files.select("path", F.explode(above).alias("folder"))
    roots = files.filter(classify.basename(F.col("path")) == "session.md").select(classify.directory(F.col("path")).alias("folder")).distinct()
    found = tried.join(roots, "folder", "left_semi").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("session_root"))
    return files.join(found, "path", "left").withColumn("session_root", F.coalesce("session_root", classify.directory(F.col("path"))))


def companions(files: DataFrame) -> DataFrame:
    """``files(path, session_root)`` → parent and sibling edges to the companion files that exist."""
    could = files.select("path", F.explode(F.transform(F.array(*[F.lit(c) for c in COMPANIONS]), lambda c: F.concat_ws("/", F.col("session_root"), c))).alias("target"))
    found = could.join(files.select(F.col("path").alias("target")), "target", "left_semi").filter("target <> path")
    parent = F.col("target").endswith("/session.md")
    kind = F.when(parent, "parent_child").otherwise("sibling")
    return found.select(F.col("path").alias("source_path"), F.col("target").alias("target_path"), kind.alias("relation_type"), F.lit(1.0).alias("strength")).distinct()


def references(files: DataFrame, home: str = "/root") -> DataFrame:
    """``files(path, session_root, content)`` → edges to files the text names, by path or by a base name single in its session.

    A base name counts where it stands alone: it starts a run of name characters and ends
    before a character that is none of a word. A session's tree is walked four folders deep, up to 200 files.
    """
    tree = bounded_walk(files.select(F.col("session_root").alias("root"), "path"), 4, 200, deep_first=True).select(F.col("root").alias("session_root"), "path")
    tokens = files.select("path", "session_root", F.explode(text.path_tokens(F.col("content"))).alias("token"))
    by_path = tokens.select("path", under(F.col("session_root"), text.expand_tilde(F.col("token"), home)).alias("target"))
    by_path = by_path.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    base = classify.basename(F.col("path"))
    single = tree.groupBy("session_root", base.alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("target")).filter("n = 1").drop("n")
    runs = F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(r"(?<![\w./-])[\w.-]+"), 0))
    ends = F.flatten(F.transform(runs, lambda r: F.transform(F.filter(F.sequence(F.lit(1), F.length(r)), lambda i: (i == F.length(r)) | ~r.substr(i + 1, F.lit(1)).rlike(r"\w")), lambda i: F.substring(r, F.lit(1), i))))
    named = files.select("path", "session_root", F.explode(F.array_distinct(ends)).alias("name"))
    by_name = named.join(single.filter(F.col("name").rlike(r"^[\w.-]+$")), ["session_root", "name"]).select("path", "target")
    odd = single.filter(~F.col("name").rlike(r"^[\w.-]+$"))  # names with spaces or signs: few, looked up in the text itself
    by_odd = files.join(odd, "session_root").filter(text.mentions(F.col("content"), F.col("name"))).select("path", "target")
    every = by_path.unionByName(by_name).unionByName(by_odd)
    return every.filter("target <> path").distinct().select(*edge("cross_reference", XREF_STRENGTH))


def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` columns without ``html``, with ``href``: one row for each distinct link of a page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"'>]*)[\"']"), 1)
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(F.array_distinct(found)).alias("href"))
