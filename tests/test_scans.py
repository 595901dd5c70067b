"""Prefix scans over pieces, the depth-first walk, outcomes of requests, scores by contents, the routed chunker."""

import random
import re

import pytest
from pyspark.sql import functions as F

from memloom.operators import chunk, evaluate, lifecycle, project, strategies
from memloom.sources.files import bounded_walk


def plain_epochs(rows, null_resets):
    out, known, epoch = {}, {}, {}
    for f, s, h in sorted(rows):
        k = known.get(f)
        if k is not None and ((h is None and null_resets) or (h is not None and h != k)):
            epoch[f] = epoch.get(f, 0) + 1
        if h is not None:
            known[f] = h
        out[f, s] = epoch.get(f, 0)
    return out


@pytest.mark.parametrize("null_resets", [True, False])
@pytest.mark.parametrize("width", [3, 1 << 20])
def test_epochs_in_pieces(spark, null_resets, width):
    rng = random.Random(3)
    rows = [(f"f{rng.randint(0, 5)}", s - 40, rng.choice([None, None, "a", "b", "c"])) for s in range(300)]
    df = spark.createDataFrame(rows, "file_id string, seq long, file_hash string").withColumn("n", F.col("seq") * 2)
    got = project.epochs(df, null_resets, width)
    assert got.columns == [*df.columns, "epoch"]
    assert {(r["file_id"], r["seq"]): r["epoch"] for r in got.collect()} == plain_epochs(rows, null_resets)


def test_a_long_file_is_split_over_tasks(spark):
    n, width = 1_000_000, 1 << 17
    df = spark.range(n).select(F.when(F.col("id") >= 0, "one").otherwise("x").alias("file_id"), F.col("id").alias("seq"), F.when(F.col("id") % 10 != 3, (F.col("id") / 1000).cast("int").cast("string")).alias("file_hash"))
    got = project.epochs(df, False, width)
    assert got.agg(F.max("epoch")).first()[0] == n // 1000 - 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(file_id#\d+, __piece#\d+L", plan)) >= 2  # rows go by file and piece; summaries alone by file
    spread = df.select(F.hash("file_id", F.floor(F.col("seq") / width))).distinct().count()
    assert spread == -(-n // width)


def test_bank_counts_with_a_floor(spark):
    rng = random.Random(8)
    steps = [(f"b{rng.randint(0, 3)}", s, rng.choice(["remember", "forget", "forget", "other"])) for s in range(400)] + [("absent", 1, "remember"), ("b0", None, "remember")]
    banks = [("b0", "active", 0), ("b1", "active", 7), ("b2", "suspended", 2), ("b3", "active", 100), ("quiet", "active", 4)]
    count, no = {b: c for b, _, c in banks}, {}
    for b, s, k in sorted((x for x in steps if x[1] is not None), key=lambda x: x[1]):
        if b in count:
            if k == "remember" and dict((x[0], x[1]) for x in banks)[b] != "active":
                no[b] = no.get(b, 0) + 1
            else:
                count[b] = max(0, count[b] + {"remember": 1, "forget": -1}.get(k, 0))
    for width in (5, 1 << 20):
        got = lifecycle.bank_counts(spark.createDataFrame(banks, "bank string, status string, memory_count int"), spark.createDataFrame(steps, "bank string, seq long, kind string"), width)
        assert {r["bank"]: (r["memory_count"], r["rejected"]) for r in got.collect()} == {b: (count[b], no.get(b, 0)) for b in count}


def test_a_walk_goes_into_every_folder(spark, tmp_path):
    names = ["a.md", "b/x.md", "b/c/y.md", "b.md", "b/c/d/z.md", "b/c/d/e/deep.md", "a/1.md", "zz.md", "B.md"]
    rows = [("/r", f"/r/{x}") for x in names] + [("/q", "/q/one.md"), ("/r", "/other/x.md")]
    df = spark.createDataFrame(rows, "root string, path string")

    def walk(prefix, depth, out):
        if depth > 4:
            return
        for entry in sorted({n[len(prefix) :].split("/")[0] for n in names if n.startswith(prefix)}):
            if prefix + entry in names and len(out) < limit:
                out.append(prefix + entry)
            walk(prefix + entry + "/", depth + 1, out)

    for limit in (3, 5, 100):
        want = []
        walk("", 1, want)
        got = bounded_walk(df, 4, limit, deep_first=True).filter("root = '/r'").collect()
        assert {r["path"] for r in got} == {f"/r/{x}" for x in want[:limit]}


def test_register_updates_descriptions(spark):
    banks = spark.createDataFrame([("a", "old", "suspended"), ("b", "kept", "active")], "bank string, description string, status string")
    asked = spark.createDataFrame([("a", "new"), ("b", None), ("c", "fresh")], "bank string, description string")
    got = {tuple(r) for r in lifecycle.register(banks, asked).collect()}
    assert got == {("a", "new", "suspended", "exists"), ("b", "kept", "active", "exists"), ("c", "fresh", "active", "registered")}


def test_outcomes_of_updates_and_deletes(spark):
    files = spark.createDataFrame([("1", "indexed", "code", None), ("2", "deleted", "code", "s"), ("3", "indexed", "docs", "s")], "id string, status string, file_role string, summary string")
    asked = spark.createDataFrame([("1", "docs", None), ("2", "docs", "t"), ("3", None, "s"), ("4", "docs", "x"), ("1", None, "t")], "id string, file_role string, summary string")
    out, after = lifecycle.update_files(files, asked)
    assert {tuple(r) for r in out.collect()} == {("1", "updated"), ("2", "FILE_DELETED"), ("3", "none"), ("4", "FILE_NOT_FOUND")}
    assert {tuple(r) for r in after.collect()} == {("1", "indexed", "docs", "t"), ("2", "deleted", "code", "s"), ("3", "indexed", "docs", "s")}
    tables = {"files": files, "file_chunks": spark.createDataFrame([("1", "m"), ("3", "n")], "file_id string, memory_id string"), "file_relations": spark.createDataFrame([("r", "1", "3", "sibling")], "id string, source_file_id string, target_file_id string, relation_type string")}
    out, left = lifecycle.delete_files(tables, spark.createDataFrame([("1",), ("1",), ("2",), ("9",)], "file_id string"))
    assert {tuple(r) for r in out.collect()} == {("1", "deleted"), ("2", "FILE_ALREADY_DELETED"), ("9", "FILE_NOT_FOUND")}
    assert {r["id"]: r["status"] for r in left["files"].collect()} == {"1": "deleted", "2": "deleted", "3": "indexed"}
    assert left["file_chunks"].count() == 1 and left["file_relations"].count() == 0


def test_scores_by_contents(spark):
    queries = spark.createDataFrame([(1, "prose"), (2, "code"), (3, None)], "query_id int, content_type string")
    expected = spark.createDataFrame([(1, "Hello  World"), (1, " "), (2, "x = 1"), (2, None)], "query_id int, content string")
    results = [(1, 1, "nothing"), (1, 2, "say hello world"), (1, 3, "HELLO\n\tWORLD again"), (1, 6, "hello world late"), (2, 7, "x = 1"), (3, 1, "any")]
    got = {r["query_id"]: tuple(r)[1:] for r in evaluate.by_contents(queries, expected, spark.createDataFrame(results, "query_id int, rank int, content string")).collect()}
    assert got == {1: ("prose", 2, 2, 4, 1.0, 0.4, 0.5), 2: ("code", 2, 0, 1, 0.0, 0.0, pytest.approx(1 / 7)), 3: (None, 0, 0, 1, 0.0, 0.0, 0.0)}


def test_one_entry_for_every_source_type(spark):
    tags = ", ".join(f"t{i}" for i in range(25))
    note = f"---\ntype: note\ntags: [{tags}]\n---\n# Head\nbody with [[b]] link"
    rows = [
        ("/o", "bank", "/o/a.md", "obsidian", note), ("/o", "bank", "/o/b.md", "obsidian", "plain"), ("/v", "bank", "/v/a.md", "vault", note), ("/v", "bank", "/v/_index.md", "vault", "---\ntype: index\n---\nx"),
        ("/s", "bank", "/s/session.md", "agent-sessions", "---\nsessionId: s7\n---\nwork"), ("/s", "bank", "/s/plan.md", "agent-sessions", "see session.md"), ("/x", "bank", "/x/a.txt", "else", "One. Two."), ("/x", "bank", "/x/blank.txt", "unknown", " "),
    ]
    files = spark.createDataFrame(rows, "root string, bank string, path string, source_type string, content string")
    out = strategies.chunk_content(files).collect()
    kinds = {}
    for r in out:
        kinds.setdefault(r["source_type"], set()).add(r["path"])
    assert kinds == {"obsidian": {"/o/a.md", "/o/b.md"}, "vault": {"/v/a.md"}, "agent-sessions": {"/s/session.md", "/s/plan.md"}, "unknown": {"/x/a.txt"}}
    tagged = {r["source_type"]: len(r["tags"]) for r in out if r["path"].endswith("/a.md") and r["chunk_index"] == 1}
    assert tagged["vault"] == strategies.TAG_LIMIT and tagged["obsidian"] > strategies.TAG_LIMIT
    assert {r["metadata"]["session.id"] for r in out if r["source_type"] == "agent-sessions"} == {"s7"}
    assert chunk.note_chunks(files).count() > 0
