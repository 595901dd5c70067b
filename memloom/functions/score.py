"""The importance of a chunk: weighted factors on a base, kept between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ROLE_FACTOR = {"docs": 0.8, "code": 0.7, "config": 0.6}
MARKERS = ["TODO", "FIXME", "IMPORTANT", "BREAKING", "CRITICAL"]
WEIGHTS = {"role": 0.4, "length": 0.2, "keywords": 0.3, "header": 0.1}
BASE = 0.5


def role_factor(role: Column) -> Column:
    out = F.lit(0.0)
    for name, value in ROLE_FACTOR.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def length_factor(text: Column) -> Column:
    return F.least(F.lit(0.1), 0.1 * (1 - F.exp(-F.length(F.coalesce(text, F.lit(""))) / F.lit(250.0))))


def marker_factor(text: Column) -> Column:
    """0.1 for each marker the text has, at most 0.3."""
    upper, count = F.upper(F.coalesce(text, F.lit(""))), F.lit(0)
    for m in MARKERS:
        count = count + upper.contains(m).cast("int")
    return F.least(F.lit(0.3), count * F.lit(0.1))


def header_factor(header: Column) -> Column:
    """0.05 for each level of a Markdown heading below the first."""
    level = F.length(F.regexp_extract(F.coalesce(header, F.lit("")), "^(#+)", 1))
    return F.greatest(level - 1, F.lit(0)) * F.lit(0.05)


def importance(role: Column, text: Column, header: Column, weights: dict[str, float] | None = None, base: float = BASE, enabled: bool = True) -> Column:
    """The weighted factors on ``base``, kept between 0 and 1; ``base`` alone where scoring is not ``enabled``."""
    if not enabled:
        return F.lit(base)
    factors = {"role": role_factor(role), "length": length_factor(text), "keywords": marker_factor(text), "header": header_factor(header)}
    total = F.lit(base)
    for name, weight in (WEIGHTS if weights is None else weights).items():
        if name in factors:
            total = total + factors[name] * F.lit(weight)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
