"""Cross-tokenizer alignment against a plain version made with both libraries."""

import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from memloom.llm import align  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abcde  \n\n\t\r.,'s tre12 ", "é", "　", " ", "\x85", "\xa0", "日本", "😀", "\x1c", "▁", "<|endoftext|>", "<s>", "、", " ", "\x0b", "\x0c", "'ll ", " the", " hello, world"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """``(id, start, end)`` of both encodings' tokens, or none."""
    a, b = libraries
    if not text:
        return [], []
    left = [(i, align.loaded(A, B).a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (left, right):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, rows = 0, []
        for i, x in side:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return tuple(out)


def plain(libraries, texts):
    every = [tokens(libraries, t) for t in texts]
    links = [[(a, b) for a, p, q in left for b, r, s in right if p < s and r < q] for left, right in every]
    count = Counter(x for row in links for x in row)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (left, right), row in zip(every, links, strict=True):
        cuts = sorted({q for *_, q in left} & {q for *_, q in right})
        spelled, start = [], 0
        for cut in cuts:
            spelled.append("|".join(",".join(str(i) for i, p, _ in side if start <= p < cut) for side in (left, right)))
            start = cut
        digest = hashlib.sha256(";".join(spelled).encode()).hexdigest() if spelled else ""
        out.append((len(left), len(right), len(cuts), len(row), sum(count[x] == best[x[1]] for x in row), sum(count[x] for x in row), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [align.BYTES, 300])
def test_like_the_libraries(spark, libraries, monkeypatch, size):
    """Also with many blocks to a task."""
    monkeypatch.setattr(align, "BYTES", size)
    rng = random.Random(5)
    texts = [None, "", " ", "a", "\n", "x" * 3000, "▁", "the end " * 800, "<|endoftext|>"] + ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(300)]
    texts += texts[9:40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align(df, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain(libraries, texts)


def test_odd_tables(spark, libraries):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id int, text string")
    for c in ("block", "name", "at", "best", "id"):
        df = df.withColumn(c, df["doc_id"])
    rows = align.align(df, A, B).collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in rows) == sorted((str(i), *p) for i, p in zip([None, 1, 1, 2], plain(libraries, ["a b"] * 3 + [None]), strict=True))
    assert align.align(df.limit(0), A, B).collect() == []
    assert align.align(df.filter("doc_id = 2"), A, B).collect()[0]["n_a"] == 0


def test_vocabulary_out_of_order(tmp_path):
    import json

    spec = json.load(open(A))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order of its merges"):
        align.Pair(str(tmp_path / "t.json"), B)
