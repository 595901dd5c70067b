"""What the pipeline's stages hold in a worker's memory."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

from memloom.llm import bpe, shingles  # noqa: E402


def test_long_sketches_are_compared_in_slices():
    rng = np.random.default_rng(5)
    held = [np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) for _ in range(2)]
    rows = pd.DataFrame({"key": range(200), "root": range(200), "n": [len(held[i % 2]) for i in range(200)], "sketch": [shingles.sketch(held[i % 2]) for i in range(200)]})
    tracemalloc.start()
    found = shingles.likely(rows, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2 * (100 * 99 // 2) and ((found["a"] - found["b"]) % 2 == 0).all()
    assert peak < 16 << 20


def test_units_go_with_their_task():
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pd.concat(bpe.digests([pd.Series(["some words here", None]), pd.Series(["more words"])], path))
    model, units = bpe.loaded(path)
    assert [bpe.digest(t, model, bpe.Units(model)) for t in ("some words here", None, "more words")] == [tuple(r) for r in out.itertuples(index=False)]
    list(bpe.digests([pd.Series(["some words"])], path))
    assert not units and not units.old and not model.pairs
