"""The trigram index, the many-pattern search and the early-ending recall, against plain versions."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import evaluate, patterns, retrieve
from memloom.operators.postings import TrigramIndex
from memloom.operators.recall_index import RecallIndex

FILES = "id string, path string, keywords array<string>, tags array<string>"


def file_rows(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abÄ😀e", k=rng.randint(1, 5)))
    return [(f"f{i}", f"/{word()}/{word()}.md", [word() for _ in range(rng.randint(0, 4))], [word()] if i % 3 else None) for i in range(n)]


def same(index, files):
    for q in ("aba", "Äb", "e.md", "b/a", "😀e😀", "A", "", "zzz", "aaaa", "md a", "abab"):
        want = retrieve.full_text(files, q).select("id").collect()
        assert sorted(index.search(q).collect()) == sorted(want), q
        assert [tuple(r) for r in index.ranked(q).collect()] == [tuple(r) for r in retrieve.full_text_ranked(files, q).collect()], q


def test_trigrams_like_a_scan(spark, tmp_path):
    files = spark.createDataFrame([*file_rows(120), ("none", "", None, None), ("short", "a", [], [])], FILES)
    same(TrigramIndex(spark, f"{tmp_path}/i", 8).build(files), files)
    empty = TrigramIndex(spark, f"{tmp_path}/e", 8).build(files.limit(0))
    assert empty.search("abc").count() == 0 and empty.ranked("abc").count() == 0


def test_an_update_writes_its_own_postings_alone(spark, tmp_path):
    rows = file_rows(60)
    index = TrigramIndex(spark, f"{tmp_path}/i", 8).build(spark.createDataFrame(rows, FILES))
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/i/**/*.parquet", recursive=True)}
    changed = [("f3", "/abaa/ab.md", ["abab"], []), ("new", "/x/abaaa.md", [], ["e.md"])]
    index.update(spark.createDataFrame(changed, FILES))
    index.remove(spark.createDataFrame([("f5",)], "id string"))
    assert {p: os.stat(p).st_mtime_ns for p in before} == before
    added = index._read("postings").filter("batch = 1")
    assert {r[0] for r in added.select("id").distinct().collect()} == {"f3", "new"}
    now = spark.createDataFrame([r for r in rows if r[0] not in ("f3", "f5")] + changed, FILES)
    same(index, now)
    small = index.compact(f"{tmp_path}/c")
    same(small, now)
    assert small._read("postings").count() == index.postings().count() < index._read("postings").count()


def test_a_question_reads_its_own_slots(spark, tmp_path):
    index = TrigramIndex(spark, f"{tmp_path}/i", 16).build(spark.createDataFrame(file_rows(60), FILES))
    read = index.postings(["aba"])
    slots = {f.split("slot=")[1].split("/")[0] for f in read.inputFiles() if "slot=" in f}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan.replace("isnotnull(slot#", "") or "slot#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(gram,aba)" in plan or "In(gram" in plan
    assert len(slots) > 1  # other slots exist
    for g in ("aba", "Ä😀b", "md ", "  x"):
        slot = spark.range(1).select(index._slot(F.lit(g))).first()[0]
        assert index.postings([g])._jdf.queryExecution().optimizedPlan().toString().count(f"= {slot})") >= 1


@pytest.mark.parametrize("size", [patterns.CHARACTERS, 400])
def test_many_patterns_in_one_pass(spark, monkeypatch, size):
    monkeypatch.setattr(patterns, "CHARACTERS", size)
    rng = random.Random(4)
    texts = [(i, "".join(rng.choices("ab cé😀", k=rng.randint(0, 80)))) for i in range(150)] + [(900, None), (901, ""), (5, "ab ab")]
    items = [(i, "".join(rng.choices("ab cé😀", k=rng.randint(1, 4)))) for i in range(300)] + [(700, ""), (701, None), (702, "ab ab"), (703, "ab ab")]
    got = patterns.occurrences(spark.createDataFrame(texts, "memory_id long, content string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for i, t in texts for k, p in items if p and t and p in t)
    if size > 400:
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_no_patterns(spark):
    texts = spark.createDataFrame([("a", "x")], "memory_id string, content string")
    items = spark.createDataFrame([(1, "")], "item_id int, text string")
    assert patterns.occurrences(texts, items).collect() == [] and patterns.occurrences(texts.limit(0), items).collect() == []
    assert evaluate.containing(texts, items).columns == ["item_id", "memory_id"]


def memories(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [(f"m{i:04}", " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(1, 30)))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2])
def test_recall_that_ends_early(spark, tmp_path, n):
    rows = memories(1500)
    held = spark.createDataFrame([*rows, rows[0], ("null", None), ("blank", "")], "memory_id string, content string")
    asked = [(1, "w0 w1 w2 w290 w291"), (2, rows[7][1]), (3, rows[8][1] + " w1 w2"), (4, "nothing here"), (5, ""), (6, "w0"), (7, "w250 w251")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    index = RecallIndex(spark, f"{tmp_path}/i", n, parts=4).build(held, per_block=16)
    got, share = index.answered(queries, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieve.recall(held, queries, 5, n).collect()))
    assert share["read"] < share["blocks"]


def test_recall_of_an_empty_table(spark, tmp_path):
    held = spark.createDataFrame([], "memory_id string, content string")
    index = RecallIndex(spark, f"{tmp_path}/i").build(held)
    assert index.search(spark.createDataFrame([(1, "a b")], "query_id int, query string")).collect() == []
