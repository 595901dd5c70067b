"""What the strategies cost: each note goes to Python once, in bounded batches, and plain frontmatter needs no slow scanner."""

import pytest

from memloom.operators import strategies

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


def test_notes_are_split_once_in_bounded_batches(wide):
    out = strategies.obsidian_chunks(notes(wide), notes(wide))
    assert python_steps(out) == 2  # the parts and the fields
    assert int(wide.conf.get(BATCH)) <= 500
    assert out.count() == 6


def test_vault_notes_are_split_once(spark):
    out = strategies.vault_chunks(notes(spark), notes(spark))
    assert python_steps(out) == 3  # the parts, the fields, and what see_also names for the edges
    assert out.count() == 6


def test_plain_frontmatter_needs_no_slow_scanner(monkeypatch):
    import yaml

    blocks = ["type: note\nstatus: de\ntags: [a, b]\nsee_also: ['2']", "created: 2024-01-02\nn: 12\nx: 1.5", "a: [1, 2\nb: c", "a: 'x", "no mapping", "a: {b: c}", "", "a: b: c"]
    slow = [yaml.load(b, yaml.SafeLoader) if b not in ("a: [1, 2\nb: c", "a: 'x", "a: b: c") else None for b in blocks]
    assert [strategies.loaded(b) for b in blocks] == [x if isinstance(x, dict) else {} for x in slow]
    if yaml.__with_libyaml__:
        monkeypatch.setattr(yaml, "SafeLoader", None)
        assert strategies.loaded(blocks[0])["see_also"] == ["2"]


def test_routed_files_are_split_once(spark):
    files = notes(spark)
    every = None
    for kind in ("obsidian", "vault", "agent-sessions", "else"):
        part = files.selectExpr("root", "bank", f"replace(path, '.md', '-{kind}.md') AS path", f"'{kind}' AS source_type", "content")
        every = part if every is None else every.unionByName(part)
    out = strategies.chunk_content(every)
    # one udf in each strategy's parts, and the fields that notes, the vault's see_also and a session's own file give
    assert python_steps(out) == 8
