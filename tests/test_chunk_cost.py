"""What splitting costs: each content goes to Python once, in bounded batches, and words are cut without being packed one by one."""

import pytest

from memloom.operators import chunk

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
NOTE = "---\ntype: note\ntags: [a, b]\nsee_also: ['2']\n---\nwords [[2]] of a note"


def python_steps(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("udf(")


def notes(spark):
    return spark.createDataFrame([("/r", "r", f"/r/{i}.md", NOTE) for i in range(3)], "root string, bank string, path string, content string")


@pytest.fixture
def wide(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    yield spark
    spark.conf.set(BATCH, before)


def test_files_are_split_once_in_bounded_batches(wide):
    files = notes(wide).selectExpr("bank", "path", "'unknown' AS source_type", "content")
    out = chunk.note_chunks(files)
    assert python_steps(out) == 1
    assert int(wide.conf.get(BATCH)) <= 500
    assert [r["chunk"] for r in out.filter("path = '/r/1.md'").collect()] == [NOTE]


@pytest.mark.parametrize("content", ["a bb ccc dddd", " a  bb \t c ", "aaaaaaaaaaaa b c", "a aaaaaaaaaaaaaaa", "", "   ", "a\n\nb c d e f\ng h i j k l m"])
@pytest.mark.parametrize("limit", [1, 3, 5, 8])
def test_words_are_cut_as_packing_them_would(content, limit):
    def plain(value, ladder):
        if len(value) <= limit:
            return [value]
        if not ladder:
            return [value[i : i + limit] for i in range(0, len(value), limit)]
        return chunk.pack([q for p in value.split(ladder[0]) for q in plain(p, ladder[1:]) if q.strip()], chunk.Bounds(limit), ladder[0])

    assert chunk.split_recursive(content, limit) == plain(content, ("\n\n", "\n", " "))


def test_long_lines_are_cut_without_packing_words(monkeypatch):
    seen = []
    pack = chunk.pack
    monkeypatch.setattr(chunk, "pack", lambda pieces, *rest: seen.append(len(pieces)) or pack(pieces, *rest))
    assert len(chunk.split_recursive("word " * 10_000, 200)) == 250
    assert max(seen) <= 250
