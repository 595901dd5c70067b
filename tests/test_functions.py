from pyspark.sql import functions as F

from memloom.functions import classify, contract, score, text
from memloom.operators import chunk, strategies


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()]).alias("x")).first()["x"]


def test_wikilinks(spark):
    x = "[[Tea]] [[Bread|loaf]] [[Lake#north shore]] ![[Map]] [[Tea]] [[ ]]"
    assert one(spark, text.wikilinks, t=x) == ["Tea", "Bread", "Lake", "Map"]
    assert one(spark, text.clean_wikilinks, t="on [[Tea]], in [[Bread|the loaf]], at [[Lake#north]] by ![[Map]] [[Oak| ]]") == "on Tea, in the loaf, at Lake by Map Oak"


def test_frontmatter(spark):
    assert one(spark, text.frontmatter, t="---\na: 1\n---\nbody") == "a: 1"
    assert one(spark, text.body, t="---\na: 1\n---\nbody") == "body"
    assert one(spark, text.frontmatter, t="body") is None
    assert one(spark, text.body, t="body") == "body"


def test_mentions(spark):
    for body, want in [("see spec.md.", True), ("see a/spec.md", False), ("see spec.mdx", False), ("xspec.md", False), ("(spec.md)", True)]:
        assert one(spark, text.mentions, t=body, n="spec.md") is want


def test_keyword_tags(spark):
    assert one(spark, text.keyword_tags, t="The Quick brown fox: with quick JUMPS over lazy dogs, into rivers!") == ["quick", "brown", "jumps", "over", "lazy"]
    assert one(spark, text.keyword_tags, t="") == []


def test_tag_limit_keeps_type_and_place(spark):
    got = spark.range(1).select(text.assemble_tags(F.lit("TS"), F.lit("bank"), F.lit("alpha beta gamma delta epsilon"), F.lit("x; y|X"), 4).alias("x")).first()["x"]
    assert got == ["file-type:ts", "location:bank", "alpha", "beta"]


def test_classify(spark):
    for path, kind, role in [("/a/B.MD", "markdown", "docs"), ("/a/x.py", "recursive", "code"), ("/a/.env", "json", "docs"), ("/a/x.yml", "json", "config"), ("/a/LICENSE", "sentence", "docs"), ("/p/x.html", "markdown", "docs")]:
        assert one(spark, classify.chunker, p=path) == kind
        assert one(spark, classify.file_role, p=path) == role
    bounds = one(spark, classify.chunk_bounds, n=200)
    assert tuple(bounds) == (200, 100, 150, 50)
    assert one(spark, classify.chunk_bounds, n=4).overlap == 0
    assert [one(spark, classify.summary_words, n=n) for n in (100, 16000, 90000)] == [20, 80, 120]


def test_ignored(spark):
    seen = lambda p, *g: spark.range(1).select(classify.is_ignored(F.lit(p), list(g)).alias("x")).first()["x"]
    assert seen("/a/.git/config") and seen("/a/.env.local") and seen("/a/b.log", "*.log") and seen("/a/tmp/c", "**/tmp/**")
    assert not seen("/a/b.md", "*.log")


def test_importance(spark):
    got = lambda role, w: one(spark, lambda r: score.importance(r, F.lit(""), F.lit(""), w), r=role)
    assert [round(got(r, {"role": 0.4}), 6) for r in ("docs", "code", "config")] == [0.82, 0.78, 0.74]
    assert [round(one(spark, lambda h: score.importance(F.lit("docs"), F.lit(""), h, {"header": 1.0}), h=h), 6) for h in ("## a", "### a", "#### a")] == [0.55, 0.6, 0.65]
    assert round(one(spark, score.marker_factor, t="todo FIXME Important breaking CRITICAL"), 6) == 0.3
    assert one(spark, lambda r: score.importance(r, F.lit(""), F.lit(""), {"nothing": 5.0}), r="docs") == 0.5


def test_contract(spark):
    rows = spark.createDataFrame(
        [
            (1, '{"breadcrumb":"/a.md","chunkIndex":0,"totalChunks":3,"startLine":1,"endLine":20,"fileRole":"code","note.title":"T","n":1}'),
            (2, '{"file_path":" ","chunk_index":-1}'),
            (3, '{"file_path":"/b.md","source_type":"odd","edges":[{"target_path":"/c","relation_type":"sibling"},{"target_path":"/d","relation_type":"no"}],"extra":{"k":"v"},"k":"w"}'),
            (4, "no json"),
        ],
        "id int, payload string",
    )
    got = {r["id"]: r for r in contract.parse(rows).collect()}
    assert (got[1]["file_path"], got[1]["chunk_index"], got[1]["total_chunks"], got[1]["start_line"], got[1]["end_line"], got[1]["file_role"], got[1]["extra"]) == ("/a.md", 0, 3, 1, 20, "code", {"note.title": "T"})
    assert got[2]["file_path"] is None and got[2]["chunk_index"] is None and got[2]["total_chunks"] == 1
    assert got[3]["source_type"] == "unknown" and [e["target_path"] for e in got[3]["edges"]] == ["/c"] and got[3]["extra"] == {"k": "v"}
    assert got[4]["file_path"] is None


def test_splitters():
    body = "para one is here.\n\n" + "word " * 100 + "\n\nlast"
    for limit in (20, 50, 200):
        for kind in chunk.SPLITTERS:
            parts = chunk.split_one(body, kind, chunk.Bounds(limit))
            assert parts and max(map(len, parts)) <= limit
            assert "".join("".join(parts).split()) == "".join(body.split())
    whole = chunk.Bounds(100)
    assert chunk.split_one("# A\ntext\n## B\nmore", "markdown", whole) == ["# A\ntext", "## B\nmore"]
    assert chunk.split_one('{"a": 1, "b": [1, 2]}', "json", whole) == ['"a": 1,\n"b": [1, 2]']
    assert chunk.split_one("  \n ", "sentence", whole) == [] and chunk.split_one(None, "json", whole) == []


def test_splitters_keep_the_bounds():
    said = [f"Sentence number {i} is of some length." for i in range(9)]
    plain = chunk.split_one(" ".join(said), "sentence", chunk.Bounds(120, 0, 80))
    assert plain == [" ".join(said[i : i + 2]) for i in (0, 2, 4, 6)] + said[8:]  # two sentences reach the target
    assert chunk.split_one(" ".join([*said[:2], "No."]), "sentence", chunk.Bounds(120, 10, 80)) == [" ".join([*said[:2], "No."])]  # a short one joins beyond it
    over = chunk.split_one(" ".join(said[:4]), "sentence", chunk.Bounds(120, 0, 80, 20))
    assert over[1] == "is of some length. " + " ".join(said[2:4])
    assert chunk.split_one('["a", "b", "cccccccccc"]', "json", chunk.Bounds(16, 5)) == ['"a",\n"b"', '"cccccccccc"']
    code = chunk.split_one("one two\nthree four\nfive six", "recursive", chunk.Bounds(20, overlap=8))
    assert code == ["one two\nthree four", "four five six"] and chunk.split_one("x" * 50, "recursive", chunk.Bounds(20, overlap=5)) == ["x" * 20, "x" * 20, "x" * 10]


def test_importance_can_be_switched_off(spark):
    assert one(spark, lambda r: score.importance(r, F.lit("TODO"), F.lit("## a"), base=0.7, enabled=False), r="docs") == 0.7


def test_snowflake(spark):
    r = spark.range(1).select(text.snowflake(F.lit(1_577_836_800_005), F.lit(1), F.lit(7)).alias("x")).select("x", text.snowflake_parts(F.col("x")).alias("p")).first()
    assert r["x"] == (5 << 22) | (1 << 12) | 7 and tuple(r["p"]) == (5, 1, 7)
    assert spark.range(1).select((text.chunk_number(F.lit("/a"), F.lit(1)) == text.chunk_number(F.lit("/a"), F.lit(1))).alias("x")).first()["x"]


def test_note_fields(spark):
    fronts = ["type: note\nStatus: open\nstatus: done\ntags: [a, 1, b]\ncreated: 2024-01-02\ncreatedAt: 2024-01-02\nRating: 3\nlinks: {x: [1, 2]}\nsee_also: lake", "- no mapping", "a: [", None]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fronts)], "i int, f string")
    got = [r["n"] for r in rows.select("i", strategies.note_fields(F.col("f"), "obsidian").alias("n")).orderBy("i").collect()]
    f = got[0]["fields"]
    assert (f["note.type"], f["note.status"], f["note.tags"], f["note.created"], f["note.aliases"], f["note.base"]) == ("note", "done", '["a","b"]', "", "[]", "")
    assert f["note.properties.rating"] == "3" and f["note.properties.links"] == '{"x":[1,2]}' and f["note.properties.createdat"] == '"2024-01-02T00:00:00.000Z"'
    assert got[0]["tags"] == ["a", "b"] and got[0]["see_also"] == ["lake"] and not got[0]["is_index"]
    assert got[1]["tags"] == [] and len(got[1]["fields"]) == 8 and got[2]["fields"]["note.type"] == "" and got[3]["fields"] is None
    vault = rows.select("i", strategies.note_fields(F.col("f"), "vault").alias("n")).orderBy("i").first()["n"]["fields"]
    assert vault["note.created"] == "2024-01-02T00:00:00.000Z" and vault["note.properties.created"] == '"2024-01-02T00:00:00.000Z"' and vault["note.properties.see_also"] == "lake"


def test_strategies_put_chunks_together(spark):
    notes = spark.createDataFrame([("/v", "b", "/v/n.md", "---\ntype: note\ntags: [x]\nsee_also: [m, gone]\n---\nSee [[m|that]].\n\nMore."), ("/v", "b", "/v/_index.md", "[[m]]"), ("/v", "b", "/v/m.md", "plain")], "root string, bank string, path string, content string")
    rows = strategies.vault_chunks(notes, notes, strategies.lines).orderBy("path", "chunk_index").collect()
    assert [(r["path"], r["chunk_index"], r["total_chunks"], r["chunk"]) for r in rows] == [("/v/m.md", 0, 1, "plain"), ("/v/n.md", 0, 3, "---\ntype: note\ntags: [x]\nsee_also: [m, gone]\n---"), ("/v/n.md", 1, 3, "See that."), ("/v/n.md", 2, 3, "More.")]
    assert rows[0]["edges"] is None and rows[0]["metadata"] == {}
    assert [tuple(e)[:2] for e in rows[2]["edges"]] == [("/v/m.md", "backlink"), ("/v/m.md", "recommendation")]
    assert rows[1]["tags"] == ["frontmatter", "metadata", "vault-node", "x"] and rows[1]["importance"] == 0.9 and rows[2]["tags"][-1] == "x"
    assert rows[2]["metadata"]["note.wikilinks"] == '["m"]' and rows[2]["metadata"]["note.see_also"] == '["m","gone"]'
    files = spark.createDataFrame([("b", "/s/session.md", "---\nsessionId: s1\nstatus: open\nphase: 3\n---\nstart"), ("b", "/s/plans/implementation-plan.md", "see session.md")], "bank string, path string, content string")
    got = strategies.session_chunks(files, strategies.lines).orderBy("path", "chunk_index").collect()
    assert [(e["relation_type"], e["target_path"]) for e in got[0]["edges"]] == [("cross_reference", "/s/session.md"), ("parent_child", "/s/session.md")]
    assert all(r["metadata"] == {"session.id": "s1", "session.createdAt": "", "session.status": "open", "session.phase": "", "session.nextAgent": ""} for r in got) and len(got) == 3
    sent = contract.parse(contract.wire(strategies.session_chunks(files, strategies.lines)).select("payload")).collect()
    assert {tuple(r["parent_unit"]) for r in sent} == {("session-s1", "open")} and {r["file_path"] for r in sent} == {"/s/session.md", "/s/plans/implementation-plan.md"}


def test_note_chunks(spark):
    rows = [("b", "/b/n.md", "vault", "---\ntype: note\ntags: [x, y]\n---\nSee [[A|b]] now."), ("b", "/b/_index.md", "vault", "text"), ("b", "/b/e.md", "vault", " "), ("b", "/b/i.md", "vault", "---\ntype: index\n---\nx")]
    got = chunk.note_chunks(spark.createDataFrame(rows, "bank string, path string, source_type string, content string")).orderBy("chunk_index").collect()
    assert [(r["path"], r["chunk_index"], r["total_chunks"], r["chunk"]) for r in got] == [("/b/n.md", 0, 2, "---\ntype: note\ntags: [x, y]\n---"), ("/b/n.md", 1, 2, "See b now.")]
    assert got[1]["tags"][-2:] == ["x", "y"]


def test_yaml(spark):
    got = spark.createDataFrame([("a: 1\nd: 2024-01-02",), ("- x",), ("a: [",), (None,)], "t string").select(chunk.yaml_json(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == ['{"a": 1, "d": "2024-01-02"}', None, None, None]
