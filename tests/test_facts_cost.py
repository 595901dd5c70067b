"""Links and frontmatter are read from contents once, and lines that repeat are parsed once."""

from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import strategies

LINKED = "---\ntype: note\ntags: [a, b]\nsee_also: ['2']\n---\nwords [[2]] of a note"


def link_scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(r"\[\[(")


def test_contents_are_looked_through_for_links_once(spark):
    notes = spark.createDataFrame([("/r", "r", f"/r/{i}.md", LINKED) for i in range(3)], "root string, bank string, path string, content string").repartition(2)
    vault, plain = (f(notes, notes) for f in (strategies.vault_chunks, strategies.obsidian_chunks))
    only = notes.select(text.wikilinks(text.body(F.col("content"))))
    for out in (vault, plain):
        assert 1 <= link_scans(out) <= link_scans(only)  # what the edges need was written before
    got = {r["path"]: [(e["relation_type"], e["target_path"]) for e in r["edges"] or []] for r in vault.filter("chunk_index = 0").collect()}
    assert got == {"/r/0.md": [("backlink", "/r/2.md"), ("recommendation", "/r/2.md")], "/r/1.md": [("backlink", "/r/2.md"), ("recommendation", "/r/2.md")], "/r/2.md": []}


def test_repeated_lines_are_parsed_once(monkeypatch):
    import yaml

    strategies._line.cache_clear()
    asked, load = [], yaml.load
    monkeypatch.setattr(yaml, "load", lambda *a: asked.append(a[0]) or load(*a))
    got = [strategies.loaded(f"type: note\ntags: [a, b]\nn: {i}") for i in range(20)]
    assert got == [{"type": "note", "tags": ["a", "b"], "n": i} for i in range(20)]
    assert len(asked) == 22 and all("\n" not in x for x in asked)


def test_blocks_are_found_by_place(spark):
    texts = ["---\na: 1\n---\nbody", "---\n\n---", "---\n---\nx", "---\na\n---b\n---\nc", " ---\na\n---\n", "---\na", "", None, "---\né😀: 1\n---\n\nü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(text.frontmatter(F.col("t")), text.body(F.col("t")), text.has_frontmatter(F.col("t"))).collect()]
    assert got == [("a: 1", "body", True), ("", "", True), (None, "---\n---\nx", False), ("a", "b\n---\nc", True), (None, " ---\na\n---\n", False), (None, "---\na", False), (None, "", False), (None, None, False), ("é😀: 1", "\nü", True)]
