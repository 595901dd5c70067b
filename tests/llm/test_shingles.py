"""The near-duplicate stage against all pairs of texts."""

import random

import numpy as np
import pandas as pd
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from memloom.llm import shingles  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(4)
    missed = tried = 0
    for n in [*range(1, 60), 100, 333, 2000]:
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
            at = int(rng.integers(0, n // 4 + 1))
            a, b = (np.unique(np.concatenate((both, x))) for x in (extra[:at], extra[at:]))
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            missed, tried = missed + (len(np.intersect1d(shingles.bands(a), shingles.bands(b))) == 0), tried + 1
            assert shingles.may_be_similar(shingles.sketch(a), len(a), shingles.sketch(b), len(b))
    assert missed <= 1 and tried > 1000
    apart = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(60)]
    assert all(len(np.intersect1d(shingles.bands(x), shingles.bands(y))) == 0 for x, y in zip(apart, apart[1:], strict=False))


def test_stage_against_all_pairs(spark):
    import corpus_pipeline

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for n in (6, 9, 14, 40, 40, 90, 200, 500):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += [" ".join(edited(rng, base, rng.randrange(1 + n // 20))) for _ in range(8)]
        texts += [" ".join(base + passage), " ".join(base[: n * 9 // 10])]
    texts += ["", None, "one two", "One  TWO"]
    rng.shuffle(texts)
    sets, label = [plain(t) for t in texts], list(range(len(texts)))
    close = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in texts:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([(i, t, "en", "a", None) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = corpus_pipeline.near_duplicates_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_stage_with_odd_ids(spark):
    import corpus_pipeline

    x, y = "the river rose again after three days of rain", "flour and water are left to rest for a night"
    rows = [(1, x), (2, x), (2, y), (None, y), (None, "a b c"), (None, "a b c"), (3, "u v w"), (3, "u v w")]
    df = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates_stage(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, x), (2, y), (None, "a b c"), (3, "u v w")], key=str)
    assert corpus_pipeline.near_duplicates_stage(spark, df.limit(0), "").count() == 0


def test_blocks_list_what_pairs_would(spark, monkeypatch):
    monkeypatch.setattr("memloom.llm.shingles.HOT", 1)
    monkeypatch.setattr("memloom.llm.shingles.BLOCK", 3)
    test_stage_against_all_pairs(spark)


def test_likely_holds_where_pairs_may_be_similar():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (20, 31, 33, 60, 70)]
    sets = [np.unique(np.concatenate((b[int(k) :], rng.integers(0, 1 << 63, int(k), dtype=np.uint64)))) for b in base for k in (0, 1, 3, 6, 12)]
    rows = pd.DataFrame({"key": range(len(sets)), "root": [i // 2 for i in range(len(sets))], "n": [len(x) for x in sets], "sketch": [shingles.sketch(x) for x in sets]})
    got = {tuple(r) for r in shingles.likely(rows, rows).itertuples(index=False)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if i // 2 != j // 2 and shingles.may_be_similar(rows["sketch"][i], rows["n"][i], rows["sketch"][j], rows["n"][j])}
    assert got == want and want
