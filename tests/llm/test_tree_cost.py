"""Queries go through a tree together, and their scores stay exact."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from memloom.llm import mtree  # noqa: E402
from memloom.llm.vectors import Best  # noqa: E402


def test_queries_open_a_page_together(monkeypatch):
    rng = np.random.default_rng(3)
    v = np.floor(1024 * rng.normal(size=(2000, 16)))
    tree = mtree.Tree(np.arange(2000), np.arange(2000), v, float((v**2).sum(axis=1).max()))
    opened, pop = [], mtree.heapq.heappop
    monkeypatch.setattr(mtree.heapq, "heappop", lambda heap: opened.append(1) or pop(heap))
    best = Best(np.full(200, -np.inf), 11, True)
    mtree.visit(0, mtree.pickle.dumps(tree), {"v": v[:200]}, best)
    q, ids, _, scores, _ = best.rank()
    for i in range(200):
        every = (v @ v[i]).astype(np.int64)
        want = np.lexsort((np.arange(2000), -every))[:11]
        assert list(ids[q == i]) == list(want) and list(scores[q == i]) == list(every[want])
    assert len(opened) < 400  # a query of its own opens over half of some 60 pages


def test_scores_beyond_doubles_are_exact():
    rng = np.random.default_rng(4)
    v = np.floor(2.0**29 * rng.normal(size=(300, 4)))
    tree = mtree.Tree(np.arange(300), np.arange(300), v, float((v**2).sum(axis=1).max()))
    best = Best(np.full(300, -np.inf), 5, True)
    mtree.visit(0, mtree.pickle.dumps(tree), {"v": v}, best)
    q, ids, _, scores, _ = best.rank()
    whole = v.astype(np.int64)
    for i in range(300):
        want = np.lexsort((np.arange(300), -(whole @ whole[i])))[:5]
        assert list(ids[q == i]) == list(want) and list(scores[q == i]) == list((whole @ whole[i])[want])
