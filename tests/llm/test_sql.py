"""The numbered operators that SQL can express give the SQL's rows on the smallest driver tables."""

import os

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from memloom.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == want
