"""URL filter: host/path rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov models of the folded ``host || path``:
one of the URLs that rules allow, one of those that rules block. Order three blends into
two and one by ``(n(ctx c) + MU * P_shorter(c)) / (n(ctx) + MU)``. A URL's score is its
log-likelihood difference divided by its length; the cut is set midway between the class
means on a held-out quarter of the rule-labelled URLs (by MD5 of the URL).

All of it is DataFrame and SQL functions. Counting is one aggregation to at most SYMBOLS**3
rows per class (pre-aggregated before the shuffle); that bounded table alone reaches the
driver, and comes back as one constant array. Judging is a projection: no join, no shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ALPHABET = "abcdefghijklmnopqrstuvwxyz.-/_%~"
DIGIT, OTHER, START = len(ALPHABET) + 1, len(ALPHABET) + 2, 0
SYMBOLS = len(ALPHABET) + 3
MU = 4.0
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def parse(pages: DataFrame, id_col: str, url_col: str, rules: list) -> DataFrame:
    """``(page_id, __url, host, path, rule, ruled)``; the longest rule string that fits wins."""
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = host_path(F.col("__url"))
    out = out.select("page_id", "__url", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return out.select("*", rule.alias("rule"), verdict.alias("ruled"))


def grams() -> Column:
    """Codes of the order-three grams of ``host || path``, one for each character."""
    folded = f"regexp_replace(translate(concat(host, path), '{UPPER}', '{UPPER.lower()}'), '[0-9]', '0')"
    codes = f"transform(filter(split({folded}, ''), c -> c <> ''), c -> if(c = '0', {DIGIT}, if(instr('{ALPHABET}', c) > 0, instr('{ALPHABET}', c), {OTHER})))"
    s = SYMBOLS
    return F.expr(
        f"transform(array({codes}), a -> transform(a, (c, i) -> if(i > 1, get(a, i - 2), {START}) * {s * s} + if(i > 0, get(a, i - 1), {START}) * {s} + c))[0]"
    )


def held_out() -> Column:
    return F.substring(F.md5(F.col("__url").cast("binary")), 1, 1).isin("0", "1", "2", "3")


def log_ratios(counts: dict[str, dict[int, int]]) -> list[float]:
    """Natural log P(allow) - log P(block) of each gram code, from the counts of each class."""
    s, logs = SYMBOLS, {}
    for kind in ("allow", "block"):
        three = counts.get(kind, {})
        n3, n2, n2c, n1, n1c, total = [0] * s**3, [0] * s**2, [0] * s**2, [0] * s, [0] * s, 0
        for code, n in three.items():
            n3[code] += n
            n2c[code // s] += n
            n2[code % (s * s)] += n
            n1c[code // s % s] += n
            n1[code % s] += n
            total += n
        p1 = [(n1[c] + 1.0) / (total + s) for c in range(s)]
        p2 = [(n2[k] + MU * p1[k % s]) / (n1c[k // s] + MU) for k in range(s * s)]
        logs[kind] = [math.log((n3[k] + MU * p2[k % (s * s)]) / (n2c[k // s] + MU)) for k in range(s**3)]
    return [a - b for a, b in zip(logs["allow"], logs["block"], strict=True)]


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages``.

    A null URL or one without ``://`` has an empty host and path and the score 0; so has a
    table without rule-labelled URLs, where every score is 0 and the cut 0, which allows.
    Repeated rows come back repeated. Rules are a driver-side list (up to a few hundred).
    """
    parsed = parse(pages, id_col, url_col, RULES if rules is None else rules)
    known = parsed.filter("ruled is not null").withColumn("held", held_out())
    rows = (
        known.filter("not held").select("ruled", F.explode(grams()).alias("g")).groupBy("ruled", "g").agg(F.count("*").alias("n")).collect()
    )  # at most 2 * SYMBOLS**3 rows
    counts: dict[str, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["ruled"], {})[r["g"]] = r["n"]
    both = len(counts) == 2
    model = log_ratios(counts) if both else [0.0] * SYMBOLS**3
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    total = F.aggregate(F.col("__grams"), F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    score = F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(F.lit(0.0))
    cut = 0.0
    if both:
        means = {r["ruled"]: r["m"] for r in known.filter("held").withColumn("__grams", grams()).filter(F.size("__grams") > 0).groupBy("ruled").agg(F.avg(score).alias("m")).collect()}
        if len(means) == 2:
            cut = (means["allow"] + means["block"]) / 2
    scored = parsed.withColumn("__grams", grams()).withColumn("score", score)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
