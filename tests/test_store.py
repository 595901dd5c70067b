import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import evaluate, links, project, retrieve
from memloom.sources import files as source
from memloom.sources.store import Store
from memloom.streaming import events

ROW = """bank string, path string, seq long, memory_id string, chunk_index int, start_line int, end_line int, section_header string, chunk_hash string, file_hash string, source_type string,
file_role string, language string, summary string, extra map<string,string>, tags array<string>, parent_unit struct<ref:string,summary:string>,
edges array<struct<target_path:string,relation_type:string,strength:double,description:string>>, content string, importance double"""


def remembered(seq, memory, file_hash, index=0, path="/a.md", tags=("t",), edges=(), line=1, **more):
    row = {"bank": "b", "path": path, "seq": seq, "memory_id": memory, "chunk_index": index, "start_line": line, "end_line": line, "section_header": None, "chunk_hash": None, "file_hash": file_hash, "source_type": "unknown", "file_role": None, "language": None, "summary": None, "extra": {}, "tags": list(tags), "parent_unit": None, "edges": list(edges), "content": f"text of {memory}", "importance": 0.5}
    return tuple((row | more).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def facts(tables, *names):
    return {n: sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in tables[n].collect()) for n in names or tables}


def test_epochs_follow_the_last_known_hash(spark):
    rows = [(0, "A"), (1, "A"), (2, "B"), (3, "B"), (4, None), (5, "B")]
    df = spark.createDataFrame([("f", s, h) for s, h in rows], "file_id string, seq int, file_hash string")
    assert [r["epoch"] for r in project.epochs(df).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]
    assert [r["epoch"] for r in project.epochs(df, False).orderBy("seq").collect()] == [0, 0, 1, 1, 1, 1]


def test_materialize_is_idempotent_and_rebuilds(spark):
    edge = ("/z.md", "sibling", 1.0, None)
    old = [remembered(0, "m0", "h1", edges=[edge]), remembered(1, "m1", "h1", 1, tags=("u", "t"), source_type="vault")]
    once, twice = project.materialize(frame(spark, old)), project.materialize(frame(spark, old + [r[:2] + (r[2] + 10,) + r[3:] for r in old]))
    assert facts(once) == facts(twice)
    f = {r["path"]: r for r in once["files"].collect()}
    assert f["/a.md"]["total_chunks"] == 2 and f["/a.md"]["tags"] == ["t", "u"] and f["/a.md"]["source_type"] == "vault" and f["/z.md"]["status"] == "pending"
    new = project.materialize(frame(spark, [*old, remembered(5, "m2", "h2")]))
    assert [r["memory_id"] for r in new["file_chunks"].collect()] == ["m2"]
    assert new["file_relations"].count() == 0


def test_no_relation_to_itself(spark):
    out = project.materialize(frame(spark, [remembered(0, "m", "h", edges=[("/a.md", "sibling", 1.0, None)])]))
    assert out["file_relations"].count() == 0 and out["files"].count() == 1


def test_a_null_keeps_the_value_of_the_same_index(spark):
    rows = [remembered(0, "m", "h", line=7), remembered(1, "m", "h", line=None)]
    assert project.materialize(frame(spark, rows))["file_chunks"].first()["start_line"] == 7
    rows[1] = remembered(1, "m", "h", index=4, line=None)
    assert project.materialize(frame(spark, rows))["file_chunks"].first()["start_line"] == 0


def test_store_rebuilds_and_deletes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("files") is None
    edge = ("/z.md", "sibling", 1.0, None)
    store.remember(frame(spark, [remembered(0, "m0", "h1", edges=[edge]), remembered(1, "m1", "h1", 1), remembered(2, "n0", "k", path="/n.md")]))
    before = facts({t: store.read(t) for t in ("files", "file_chunks", "file_relations")})
    store.remember(frame(spark, [remembered(0, "m0", "h1", edges=[edge]), remembered(1, "m1", "h1", 1)]))
    assert facts({t: store.read(t) for t in ("files", "file_chunks", "file_relations")}) == before
    store.remember(frame(spark, [remembered(9, "m2", "h2")]))
    assert sorted(r["memory_id"] for r in store.read("file_chunks").collect()) == ["m2", "n0"]
    assert store.read("file_relations").count() == 0 and store.read("memories").count() == 4
    gone = store.read("files").filter("path = '/n.md'").select(F.col("id").alias("file_id"))
    store.delete(gone)
    assert {r["path"]: r["status"] for r in store.read("files").collect()} == {"/a.md": "indexed", "/n.md": "deleted", "/z.md": "pending"}
    assert store.read("file_chunks").count() == 1


def stamps(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def test_a_batch_writes_the_partitions_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 64)
    edge = ("/f1.md", "sibling", 1.0, None)
    many = [remembered(i, f"m{i}", "h", path=f"/f{i}.md", edges=[edge] if i in (2, 3) else []) for i in range(12)]
    store.remember(frame(spark, many), 0)
    before, n = stamps(tmp_path / "s"), store.read("files").count()
    store.remember(frame(spark, [remembered(20, "new", "h2", path="/f1.md")]), 1)
    after = stamps(tmp_path / "s")
    part = lambda key: store.spark.createDataFrame([(key,)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(64))).first()[0]
    ids = {r["path"]: r["id"] for r in store.read("files").collect()}
    own = {part(ids["/f1.md"])}
    sources = {part(ids[p]) for p in ("/f2.md", "/f3.md")}
    touched = {t: {int(p.split("part=")[1].split("/")[0]) for p in before.keys() ^ after.keys() if p.startswith(f"{t}/")} for t in ("files", "file_chunks", "file_relations", "memories")}
    assert touched == {"files": own, "file_chunks": own, "file_relations": sources, "memories": {part("new")}}
    assert all(after[p] == before[p] for p in before.keys() & after.keys())
    assert store.read("file_relations").count() == 0 and store.read("files").count() == n
    store.remember(frame(spark, [remembered(30, "other", "h3", path="/f1.md")]), 1)  # given again: nothing happens
    assert stamps(tmp_path / "s") == after and store.last_batch() == 1


def test_a_lost_batch_is_given_again(spark, tmp_path, monkeypatch):
    batch = [remembered(9, "m2", "h2"), remembered(10, "n1", "k", path="/n.md")]
    first = [remembered(0, "m0", "h1", edges=[("/n.md", "sibling", 1.0, None)]), remembered(1, "m1", "h1", 1)]
    whole = Store(spark, f"file://{tmp_path}/whole")
    whole.remember(frame(spark, first), 0)
    whole.remember(frame(spark, batch), 1)
    for lost in ("file_chunks", "files"):
        store = Store(spark, f"file://{tmp_path}/{lost}")
        store.remember(frame(spark, first), 0)
        write = Store._write

        def fail(self, table, *rest, lost=lost, write=write):
            if table == lost:
                raise RuntimeError("lost")
            write(self, table, *rest)

        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(Store, "_write", fail)
            store.remember(frame(spark, batch), 1)
        store.remember(frame(spark, batch), 1)
        names = ("memories", "files", "file_chunks", "file_relations")
        assert facts({t: store.read(t) for t in names}) == facts({t: whole.read(t) for t in names})


def test_report_lines(spark):
    scores = spark.createDataFrame([(1, 1.0, 0.2, 1.0), (2, 0.0, 0.0, 0.0)], "query_id int, recall double, precision double, mrr double")
    lines = {(r["kind"], r["line"]) for r in evaluate.report(scores, "run", 0.7).collect()}
    assert ("query", '{"mode":"run","query_id":1,"recall":1.0,"precision":0.2,"mrr":1.0}') in lines
    assert ("mean", '{"mode":"run","queries":2,"recall":0.5,"precision":0.1,"mrr":0.5,"blocking":true}') in lines


def test_containing_more_than_an_automaton_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"tiny item {i} here and some more words of a longer passage {i} that goes on") for i in range(7)], "memory_id long, content string")
    items = spark.createDataFrame([(i, f"item {i}") for i in range(7)] + [(10 + i, f"words of a longer passage {i} that") for i in range(7)], "item_id long, text string")
    want = sorted([(i, i) for i in range(7)] + [(10 + i, i) for i in range(7)])
    for size in (10_000, 20):
        monkeypatch.setattr("memloom.operators.patterns.CHARACTERS", size)
        assert sorted(tuple(r) for r in evaluate.containing(docs, items).collect()) == want


def test_forget_leaves_a_tombstone(spark):
    t = project.materialize(frame(spark, [remembered(0, "m0", "h"), remembered(1, "m1", "h", 1), remembered(2, "m0", "k", path="/n.md")]))
    out = project.forget(t, spark.createDataFrame([("m0",)], "memory_id string"))
    assert {r["path"]: (r["status"], r["total_chunks"]) for r in out["files"].collect()} == {"/a.md": ("indexed", 1), "/n.md": ("deleted", 0)}


CHUNK = "file_id string, memory_id string, chunk_index int, start_line int, end_line int, section_header string, content_hash string, parent_unit_summary string"


def chunks(spark, rows):
    return spark.createDataFrame([(f, m, i, i, i, None, None, None) for f, m, i in rows], CHUNK)


def test_fetch(spark):
    c = chunks(spark, [("f", "b", 1), ("f", "a", 0), ("f", "c", 5), ("f", "d", 9)])
    m = spark.createDataFrame([("a", "A"), ("b", ""), ("c", "C"), ("d", "D")], "memory_id string, content string")
    got = retrieve.fetch_whole(c, m).first()
    assert got["content"] == "A\n<< missing chunk b (index=1, lines=1-1) >>\nC\nD" and got["status"] == "partial" and got["missing"] == ["b"]
    near = lambda centre, n: sorted(r["memory_id"] for r in retrieve.fetch_neighbours(c, spark.createDataFrame([("f", centre)], "file_id string, centre int"), n).collect())
    assert near(5, 1) == ["b", "c", "d"] and near(0, 1) == ["a", "b"] and near(5, 0) == ["c"] and near(7, 1) == []
    with pytest.raises(ValueError):
        near(0, 6)


def test_edges_are_ranked_before_repeated_files_go(spark):
    r = spark.createDataFrame([("r1", "f", "g", "version", 1.0, "d"), ("r2", "f", "g", "sibling", 0.9, None), ("r3", "h", "f", "sibling", 0.5, None), ("r4", "x", "y", "version", 1.0, None)], "id string, source_file_id string, target_file_id string, relation_type string, strength double, description string")
    f = spark.createDataFrame([("f", "/f", None), ("g", "/g", "G"), ("h", "/h", None)], "id string, path string, summary string")
    own = spark.createDataFrame([("f",)], "file_id string")
    two, three = retrieve.strongest(own, r, 2), retrieve.strongest(own, r, 3)
    assert [(x["id"], x["other_id"]) for x in two.orderBy("n").collect()] == [("r1", "g"), ("r2", "g")]
    assert [(x["other_id"], x["relation"], x["summary"]) for x in retrieve.related(two, f).collect()] == [("g", "version", "G")]
    assert [(x["other_id"], x["n"]) for x in retrieve.related(three, f).orderBy("n").collect()] == [("g", 1), ("h", 3)]


def test_bm25(spark):
    rows = [("1", "/docs/alpha.md", ["alpha"], []), ("2", "/docs/beta.md", [], ["alphabet", "alpha"]), ("3", "/x/gamma.md", [], [])]
    f = spark.createDataFrame(rows, "id string, path string, keywords array<string>, tags array<string>")
    docs = {i: " ".join(x for x in [p, " ".join(k), " ".join(t)]).lower() for i, p, k, t in rows}
    grams = {i: Counter(d[j : j + 3] for j in range(len(d) - 2)) for i, d in docs.items()}
    mean, want = sum(map(len, (list(g.elements()) for g in grams.values()))) / 3, {}
    for i, d in docs.items():
        if "alpha" in d:
            s, n = 0.0, sum(grams[i].values())
            for g in {"alp", "lph", "pha"}:
                df = sum(g in x for x in grams.values())
                tf = grams[i][g]
                s += math.log((3 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
            want[i] = round(s, 6)
    assert {r["id"]: r["score"] for r in retrieve.full_text_ranked(f, "Alpha").collect()} == pytest.approx(want)
    assert retrieve.full_text(f, "al").count() == 0


def test_vault_ladder(spark):
    body = "[[top]] [[near]] [[deep/one.md]] [[only]] [[twice]] [[only.part]] [[no such]]"
    paths = ["/v/top.md", "/v/a/near.md", "/v/deep/one.md", "/v/x/only.md", "/v/x/twice.md", "/v/y/twice.md", "/v/z/only.part.md", "/v/a/self.md"]
    cat = spark.createDataFrame([("/v", p) for p in paths], "root string, path string")
    notes = spark.createDataFrame([("/v", "/v/a/self.md", body)], "root string, path string, content string")
    got = sorted(r["target_path"] for r in links.vault_links(notes, cat).collect())
    assert got == ["/v/a/near.md", "/v/deep/one.md", "/v/top.md", "/v/z/only.part.md"]  # "only" fits only.md and only.part.md


def test_vault_ladder_skips_the_note_itself(spark):
    cat = spark.createDataFrame([("/v", p) for p in ("/v/a/x.md", "/v/b/x.md", "/v/c/y.md", "/v/c/y.part.md", "/v/c/z.md")], "root string, path string")
    notes = spark.createDataFrame([("/v", "/v/a/x.md", "[[x]]"), ("/v", "/v/c/y.md", "[[y]] [[c/y]]"), ("/v", "/v/c/z.md", "[[z]] [[x]]")], "root string, path string, content string")
    got = sorted((r["source_path"], r["target_path"]) for r in links.vault_links(notes, cat).collect())
    assert got == [("/v/a/x.md", "/v/b/x.md"), ("/v/c/y.md", "/v/c/y.part.md")]


def test_references(spark):
    rows = [("/s/session.md", "x"), ("/s/plans/a.md", "see plans/../session.md, deep/b.md and b.md; c.md"), ("/s/deep/b.md", "nothing"), ("/s/p/c.md", ""), ("/s/q/c.md", "a.md, ./plans/a.md"), ("/s/odd name.txt", "")]
    f = links.session_roots(spark.createDataFrame(rows, "path string, content string"))
    assert {r["session_root"] for r in f.collect()} == {"/s"}
    got = {(r["source_path"], r["target_path"]) for r in links.references(f).collect()}
    assert got == {("/s/plans/a.md", "/s/session.md"), ("/s/plans/a.md", "/s/deep/b.md"), ("/s/q/c.md", "/s/plans/a.md")}


def test_metrics(spark):
    rows = [("1", ["a", "b"], ["a", "x", "y", "z", "w", "b"]), ("2", ["a", "b", "c"], ["a", "x", "y", "z", "w"]), ("3", [], []), ("4", ["b"], ["x", "b"])]
    got = {r["query_id"]: r for r in evaluate.scored(spark.createDataFrame(rows, "query_id string, relevant array<string>, retrieved array<string>")).collect()}
    assert got["1"]["recall"] == 0.5 and got["2"]["recall"] == pytest.approx(1 / 3) and got["1"]["precision"] == 0.2
    assert (got["3"]["recall"], got["3"]["precision"], got["3"]["mrr"]) == (0, 0, 0) and got["4"]["mrr"] == 0.5
    m = lambda x: spark.createDataFrame([(x,)], "mrr double")
    assert evaluate.gate(m(0.5), m(0.65)).first()["blocking"] and not evaluate.gate(m(0.6), m(0.65)).first()["blocking"]


def test_containing(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "one two three four five six"), (3, "tiny item here"), (4, None)], "memory_id long, content string")
    items = spark.createDataFrame([(7, "one two three four five six seven"), (8, "tiny item"), (9, "")], "item_id long, text string")
    assert sorted(tuple(r) for r in evaluate.containing(docs, items).collect()) == [(7, 1), (8, 3)]


def test_event_plan(spark):
    e = spark.createDataFrame([("a", "change", 1), ("a", "change", 2), ("b", "delete", 1), ("c", "add", 1)], "path string, op string, ts int")
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("z", "9")], "path string, memory_id string")
    now = spark.createDataFrame([("a", "2"), ("a", "4"), ("c", "5"), ("b", "3")], "path string, memory_id string")
    assert sorted(tuple(r) for r in events.plan(e, old, now).collect()) == [("a", "1", "forget"), ("a", "2", "keep"), ("a", "4", "remember"), ("b", "3", "forget"), ("c", "5", "remember")]


def test_stream_equals_batch(spark, tmp_path):
    stamp = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    rows = [("a", "add", 0), ("a", "change", 2), ("a", "delete", 9), ("b", "add", 1), ("end", "add", 5000)]
    df = None
    for p, op, s in rows:
        one = spark.range(1).select(F.lit(p).alias("path"), F.lit(op).alias("op"), stamp(s).alias("ts"))
        df = one if df is None else df.unionByName(one)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = []
    query = events.run(stream, lambda batch, _: got.extend(tuple(r)[:2] + (r["n"],) for r in batch.collect()), f"{tmp_path}/cp", once=True)
    query.awaitTermination(120)
    want = sorted(tuple(r)[:2] + (r["n"],) for r in events.settled(df).collect() if r["path"] != "end")
    assert sorted(x for x in got if x[0] != "end") == want == [("a", "change", 2), ("a", "delete", 1), ("b", "add", 1)]


def test_in_flight_stream_equals_batch(spark, tmp_path):
    stamp = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    parts = [[("a", "add", 0), ("a", "change", 1), ("b", "add", 2)], [("a", "change", 2), ("a", "delete", 3), ("b", "change", 4)], [("a", "add", 5), ("a", "change", 6), ("b", "delete", 5)]]
    every = None
    for i, part in enumerate(parts):
        df = None
        for p, op, s in part:
            one = spark.range(1).select(F.lit(p).alias("path"), F.lit(op).alias("op"), stamp(s).alias("ts"))
            df = one if df is None else df.unionByName(one)
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        every = df if every is None else every.unionByName(df)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []
    query = events.in_flight_once(stream).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = sorted(map(tuple, events.in_flight_once(every).collect()))
    assert sorted(got) == want
    assert [(p, op) for p, op, _ in want] == [("a", "add"), ("a", "change"), ("a", "delete"), ("b", "add"), ("b", "delete")]


def test_scan_and_walk(spark, tmp_path):
    for name in ("a.md", "d/b.md", "d/e/c.md", ".git/x", "d/.env.x", "skip.log"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text {name}")
    got = source.scan(spark, str(tmp_path), ["*.log"])
    assert sorted(r["path"].removeprefix(f"{tmp_path}/") for r in got.collect()) == ["a.md", "d/b.md", "d/e/c.md"]
    cat = got.select(F.lit(str(tmp_path)).alias("root"), "path")
    assert source.bounded_walk(cat, 2).count() == 2 and source.bounded_walk(cat, 4, 1).first()["path"].endswith("/a.md")
    later = got.filter("path not like '%b.md'").withColumn("file_hash", F.when(F.col("path").endswith("a.md"), "new").otherwise(F.col("file_hash")))
    assert sorted(r["op"] for r in source.listing_changes(got, later).collect()) == ["change", "delete"]


def test_watch_takes_what_is_there_and_what_comes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one")
    (tmp_path / "in/.env").write_text("secret")
    got = []

    def run():
        query = source.watch(spark, f"{tmp_path}/in").writeStream.foreachBatch(lambda b, _: got.extend((r["path"].rsplit("/", 1)[1], r["content"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    assert got == [("a.md", "one")]
    (tmp_path / "in/b.md").write_text("two")
    run()
    assert got == [("a.md", "one"), ("b.md", "two")]


def test_ids(spark):
    r = spark.range(1).select(text.file_id(F.lit("b"), F.lit("/p")).alias("f"), text.snowflake_parts(F.lit((5 << 22) | (1 << 12) | 7)).alias("s")).first()
    assert len(r["f"]) == 37 and tuple(r["s"]) == (5, 1, 7)


def test_golden_gathers_no_relevant_ids(spark):
    relevant = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7)], "item_id long, memory_id long")
    retrieved = spark.createDataFrame([(1, 1, 99), (1, 2, 3), (1, 3, 4), (2, 1, 8), (4, 1, 1)], "query_id long, rank int, memory_id long")
    out = evaluate.golden(relevant, retrieved, spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long"))
    got = {r["query_id"]: (r["recall"], r["precision"], r["mrr"]) for r in out.collect()}
    assert got == {1: (2 / 50, 2 / 5, 1 / 2), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}
    assert "collect_list" not in out._jdf.queryExecution().toString()
