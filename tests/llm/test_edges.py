"""Nulls, empty tables, repeated rows, ties, long texts and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from memloom.llm import ann, bpe, html_extract, license_scan, mixing, mtree, quality, simhash, toxicity, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The river rose again after three days of rain and the town waited for the morning."
BAD = "buy now!!! $$$ click ### win%%% win%%% $$$ buy now!!!"
RUDE = "you stupid idiot, I hate you, vile idiot"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats and one very long text, with columns whose names operators might use."""
    long = ("word " * 60_000) + "end"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, GOOD, "b"), (4, GOOD, None), (4, GOOD, None), (5, long, "b"), (6, "é ▁ \x00 😀 x", "c"), (7, GOOD, "a")]
    df = documents(spark, rows)
    return df.withColumn("score", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("size", F.lit(2)).withColumn("label", F.lit(3)).withColumn("weight", F.lit(0.0)).withColumn("component_id", F.lit(9))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_documents_with_odd_values(spark, odd, labels):
    path = public_tokenizers.path("piece_bpe_32k.model")
    n = odd.count()
    assert simhash.near_duplicates(odd).count() == n
    for classify in (toxicity.classify, quality.classify):
        rows = classify(odd, labels).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    mixed = mixing.mix(odd, quality.score_of(odd, labels)).collect()
    assert len(mixed) == n and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mixed)
    assert license_scan.scan(odd).count() == n
    assert odd.select(bpe.encode_digest_column(F.col("text"), path).alias("c")).filter("c.n_tokens is null").count() == 0


def test_stages_keep_the_columns(spark, odd, labels):
    for out in (toxicity.reject(odd, labels), quality.keep(odd, labels), simhash.keep_one(odd), mixing.take(odd, quality.score_of(odd, labels))):
        assert out.columns == odd.columns
        out.collect()
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(odd).collect()) == [1, 4, 5, 6]


def test_stages_keep_columns_of_any_name(spark, labels):
    from memloom.llm import shingles

    names = ["__score", "__row", "row", "Row_", "__n", "__copy", "__key", "__bin", "__tie", "__cut", "__p", "__last", "tie", "doc", "words", "n", "col", "key", "n.b"]
    docs = documents(spark, [(i, t, "a") for i, t in ((1, GOOD), (1, GOOD), (2, GOOD), (3, BAD), (4, RUDE), (None, None))])
    wide = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    score, none_known = F.when(F.col("text") == GOOD, 0.9).otherwise(0.2), labels.limit(0)
    stages = (lambda d: toxicity.reject(d, none_known), lambda d: quality.keep(d, none_known), simhash.keep_one, shingles.keep_one, lambda d: mixing.take(d, score))
    for stage in stages:
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
        assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, (r["doc_id"] for r in stage(docs).collect())))


def test_keep_one(spark):
    df = documents(spark, [(3, GOOD, "a"), (1, GOOD, "a"), (1, GOOD, "a"), (2, None, "a"), (9, "", "a"), (None, BAD, "a"), (None, BAD, "a")])
    assert sorted(((r["doc_id"] or 0) for r in simhash.keep_one(df).collect())) == [0, 1, 2]


def test_keep_one_of_repeated_ids(spark):
    df = documents(spark, [(1, GOOD, "a"), (2, GOOD, "a"), (2, RUDE, "a")])
    for rows in (df, df.repartition(3, "text")):
        assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(rows).collect()) == [(1, GOOD), (2, RUDE)]


def test_empty_tables(spark, none, labels):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    every = [
        simhash.near_duplicates(none), simhash.keep_one(none), toxicity.classify(none, labels), quality.classify(none, labels), toxicity.reject(none, labels.limit(0)), quality.keep(none, labels.limit(0)),
        mixing.mix(none, F.lit(0.5)), mixing.take(none, F.lit(0.5)), license_scan.scan(none), none.select(bpe.encode_digest_column(F.col("text"), path)),
        ann.search(vectors, F.col("vec_id") % 20 == 0), mtree.search(vectors, F.col("vec_id") % 100 == 0), url_filter.judge_urls(pages), html_extract.main_texts(pages),
    ]
    assert [df.count() for df in every] == [0] * len(every)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (200, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (400, [None, 1.0]), (500, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [1.0, 1.0]), (3, [1.0, 0.0]), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("x"))
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.5)]
    exact = [tuple(r) for r in mtree.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    big = 1024 * 1024
    assert exact == [(0, 1, 1, big), (0, 2, 3, big), (0, 3, 2, big // 2), (0, 4, 500, 0), (500, 1, 0, 0), (500, 2, 1, 0), (500, 3, 2, 0), (500, 4, 3, 0)]


def test_vectors_one_row(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ann.search(df, F.col("vec_id") == 0).count() == 0 and mtree.search(df, F.col("vec_id") == 0).count() == 0


def test_pages_with_odd_values(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.COM/x?y", "<p>x"), (4, "x://", "<b"), (None, "http://b.net/fr/a#b", "<div>" * 3000 + "deep words here"), (4, "x://", "<b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    got = url_filter.judge_urls(df).collect()
    assert len(got) == 6 and all(r["verdict"] in ("allow", "block") for r in got)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[2]["host"], by[3]["host"], by[3]["path"], by[3]["rule"], by[None]["rule"]) == ("", "", "", "a.com", "/x", "com/", "net/fr/")
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_texts(df).collect()}
    assert texts[1] == ("", 0) and texts[2] == ("", 0) and texts[None] == ("deep words here", 15)


def test_vectors_that_share_an_id_and_of_two_lengths(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.5, 0.5]), (3, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    big = 1024 * 1024
    got = sorted(tuple(r) for r in mtree.search(df, F.col("vec_id") % 100 == 0).collect())
    want = [(0, 1, 100, big), (0, 2, 100, big // 2), (100, 1, 0, big), (100, 1, 0, big // 2), (100, 2, 100, big // 2), (100, 2, 100, big // 2), (200, 1, 3, 0)]
    assert got == sorted(want)
    near = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect())
    assert near == [(a, b, c, s / big) for a, b, c, s in sorted(want)]


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [1.0, i / 50]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for search in (ann.search, mtree.search):
        got = {}
        for r in search(df, F.col("vec_id") % 100 == 0, k=10).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert [got[0][i] for i in range(1, 11)] == list(range(1, 11)) and [got[200][i] for i in range(1, 11)] == list(range(10))


def test_scores_too_large_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e15, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        mtree.search(df, F.col("vec_id") == 0)


def test_large_scores_stay_exact(spark):
    rows = [(0, [2.0**17, 1.0])] + [(i, [2.0**17, i / 1024]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in mtree.search(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    base = (1 << 27) ** 2
    assert got == [(0, 1, 199, base + 1024 * 199), (0, 2, 198, base + 1024 * 198), (0, 3, 197, base + 1024 * 197)]


def test_string_ids_and_labels_of_other_documents(spark):
    docs = spark.createDataFrame([(f"d{i}", GOOD if i % 2 else BAD) for i in range(60)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 1 - i % 2) for i in range(60)] + [(f"other{i}", i % 2, i % 2) for i in range(5000)], "doc_id string, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    assert got == {f"d{i}": i % 2 for i in range(60)}
    assert toxicity.classify(docs, labels).count() == 60


def test_rows_of_no_partner_go_nowhere(spark):
    rows = [(i, "same words in every row here", "a") for i in (1, 1, 1)] + [(2, "other words stand in this one", "b")]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs, F.lit(1.0)).collect()
    assert len(mixed) == 4 and sum(r["taken"] for r in mixed if r["doc_id"] == 1) in (24, 30)  # target: a 3, b 1 of 36 words
    assert mixing.take(docs, F.lit(1.0)).filter("doc_id = 1").count() in (3, 6)


def test_pipeline_on_an_empty_table(spark, none, labels, tmp_path):
    import corpus_pipeline

    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_scratch_is_refused_without_a_shared_folder():
    from types import SimpleNamespace

    from memloom.llm.scratch import shared_dir

    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc))
