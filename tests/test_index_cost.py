"""What indexes and the store cost: heads of texts serve for keywords, memories and rows of a batch are computed once."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import postings, project
from memloom.operators.recall_index import RecallIndex


@pytest.mark.parametrize("limit", [1, 5])
def test_keywords_of_the_head_are_those_of_the_whole_text(spark, limit):
    r = random.Random(3)
    pieces = ["alpha", "BETA", "with", "Gamma7", "x", "é", "ΣΑΣ", "İstan", "Kelvin", "delta", "abcd" * 150, "  ", "\n"]
    texts = [" ".join(r.choice(pieces[:n]) for _ in range(r.randint(0, 200))) for n in range(1, len(pieces) + 1) for _ in range(4)]
    texts += ["a" * 507 + " " + "bcdefgh", "a" * 512, "ab " * 300 + "omega", "word " * 300 + "one1 two2 three four five", "x" * 508 + "Kel tail"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    plain = F.slice(F.array_except(F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit("[a-z0-9]{4,}"), 0), F.array(*[F.lit(w) for w in text.STOPWORDS])), 1, limit)
    got = rows.select("t", text.keyword_tags(F.col("t"), limit).alias("a"), plain.alias("b")).collect()
    assert [x["t"] for x in got if x["a"] != x["b"]] == []


def test_the_rest_of_a_long_text_is_left_alone(spark):
    plan = spark.range(1).select(text.keyword_tags(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "substring(coalesce(cast(id" in plan and f", 1, {text.KEYWORD_HEAD})" in plan


def test_trigrams_are_cut_without_a_regular_expression(spark):
    rows = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,), ("a\néb😀c",)], "d string")
    out = rows.select(postings.grams_of(F.col("d")).alias("g"))
    assert [r["g"] for r in out.collect()] == [["abc", "bcd"], [], [], [], ["a\né", "\néb", "éb😀", "b😀c"]]
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_memories_are_computed_once_for_the_recall_index(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value

    udf = F.udf(counted, "string").asNondeterministic()
    memories = spark.createDataFrame([(f"m{i}", f"word{i} shared") for i in range(40)] + [("m1", "word1 other")], "memory_id string, content string")
    index = RecallIndex(spark, f"{tmp_path}/i").build(memories.select("memory_id", udf("content").alias("content")), 8)
    assert seen.value == 41
    assert index.postings().count() == 81  # shared of all 40, a word of each, and other; repeats once
    found = index.search(spark.sql("SELECT 0L AS query_id, 'word1 other' AS query"), 1).collect()
    assert [(r["memory_id"], r["score"]) for r in found] == [("m1", 1.0)]


def test_whole_rows_take_no_part_in_epochs(spark):
    rows = [("b", "/a", i, f"m{i % 3}", i, i, i, None, f"c{i % 3}", h, "vault", "docs", "en", None, {"k": "v"}, ["t"], ("u", f"s{i}"), [("/z", "sibling", 0.5, "n")]) for i, h in enumerate(["x", "x", None, "y", "y", None, "y", "y"])]
    schema = "bank string, path string, seq long, memory_id string, chunk_index int, start_line int, end_line int, section_header string, chunk_hash string, file_hash string, source_type string, file_role string, language string, summary string, extra map<string,string>, tags array<string>, parent_unit struct<ref:string,summary:string>, edges array<struct<target_path:string,relation_type:string,strength:double,description:string>>"
    keyed = spark.createDataFrame(rows, schema).withColumn("file_id", text.file_id(F.col("bank"), F.col("path")))
    since = project.last_epoch(keyed).agg(F.min("seq")).first()[0]
    assert [r["since"] for r in project.resets(keyed).collect()] == [since]
    assert {r["memory_id"]: r["chunk_index"] for r in project.chunks_of(keyed).collect()} == {r["memory_id"]: r["i"] for r in keyed.filter(F.col("seq") >= since).groupBy("memory_id").agg(F.max("chunk_index").alias("i")).collect()}
    plan = project.relations_of(keyed)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("edges" in line for line in windows)
    assert not any("edges" in line and "__piece" in line for line in plan.splitlines())
