"""The filter audit against a plain count in every order."""

import re
from itertools import permutations

import pytest

pytest.importorskip("public_tokenizers")

from memloom.llm import audit  # noqa: E402

LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (None, LONG, "en"), (3, None, "en"), (4, "", None), (5, "", ""), (6, "$ " + LONG, "de"), (7, "same " * 300, "de"), (8, "ABC " * 100 + LONG, "de"),
    (9, "same " * 300, "en"), (10, "É" * 30 + "A", None), (11, "x\x0by\x1cz w", "fr"), (12, LONG + " | AAAA BBBB CCCC DDDD " * 40, "fr"), (13, "word " * 50_000, "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, 1, 1), (9, None, 1), (5, 1, 0)]


def failed(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]
        bad.append(doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows))
        good, toxic = (any(i == doc_id is not None and x[k] == 1 for i, *x in LABELS) for k in (0, 1))
        out.append((lang or "", dict(zip("ABCDE", bad, strict=True)), good, toxic))
    return out


def plain(rows):
    every, out = failed(rows), {}
    for part in {p for p, *_ in every}:
        own = [r[1:] for r in every if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [r for r in left if r[0][x]]
                redundant = sum(r[0][x] for r in own) - len(gone)
                left = [r for r in left if not r[0][x]]
                unique = sum(r[0][x] and sum(r[0].values()) == 1 for r in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone)]
    for (part, order, k), v in out.items():
        v.append(sum(w[1] for (p, o, j), w in out.items() if p == part and o[j - 1] == order[k - 1]))
    return out


def test_like_a_plain_count(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in ("mask", "part", "quality", "good", "digest", "f_id"):
        docs = docs.withColumn(c, docs["doc_id"])
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in audit.audit(docs, labels).collect()}
    assert got == plain(ROWS)
    assert len(audit.cells(audit.masks(docs, labels)).collect()) <= 32 * 4
    assert audit.audit(docs.limit(0), labels).count() == 0 and audit.audit(docs, labels.limit(0)).count() == len(got)


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    plan = audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
