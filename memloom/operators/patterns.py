"""Many texts looked for in many texts: one automaton over all patterns, one pass over the texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of the patterns of one automaton (about a hundred bytes of memory each); more patterns take more passes.
CHARACTERS = 2_000_000
_BUILT: dict = {}


def automaton(patterns: list[tuple[object, str]]):
    """An Aho-Corasick automaton; a pattern's value is the list of the keys that have it."""
    import ahocorasick

    keys: dict[str, list] = {}
    for key, p in patterns:
        keys.setdefault(p, []).append(key)
    out = ahocorasick.Automaton()
    for p, k in keys.items():
        out.add_word(p, k)
    if keys:
        out.make_automaton()
    return out


def occurrences(texts: DataFrame, patterns: DataFrame, id_col: str = "memory_id", text_col: str = "content", key_col: str = "item_id", pattern_col: str = "text") -> DataFrame:
    """``(key_col, id_col)``: which texts hold which patterns, each pair once a row of ``texts``.

    Patterns are broadcast as one automaton up to CHARACTERS characters; beyond it they are dealt by hash to
    several, with a pass over the texts for each. Null or empty patterns and null texts match nothing, a pattern
    under several keys matches for each. A longer pattern than CHARACTERS has an automaton of its own.
    """
    spark = texts.sparkSession
    known = patterns.select(key_col, pattern_col).filter(F.length(pattern_col) > 0)
    size = known.agg(F.sum(F.length(pattern_col))).first()[0] or 0
    passes = max(1, -(-size // CHARACTERS))
    schema = StructType([StructField(key_col, patterns.schema[key_col].dataType), StructField(id_col, texts.schema[id_col].dataType)])
    rows, out = texts.select(id_col, F.col(text_col).cast("string").alias("t")), None
    for p in range(passes):
        own = known if passes == 1 else known.filter(F.pmod(F.xxhash64(pattern_col), F.lit(passes)) == p)
        listed = spark.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()])  # about CHARACTERS characters
        part = rows.mapInArrow(_searched(listed, schema), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _searched(listed, schema: StructType):
    name = uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()  # one automaton a worker
            _BUILT[name] = automaton(listed.value)
        built = _BUILT[name]
        if not len(built):
            return
        for batch in batches:
            keys, rows = [], []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                if t:
                    found = {id(k): k for _, k in built.iter(t)}
                    for k in found.values():
                        keys += k
                        rows += [i] * len(k)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(rows))], schema.names)

    return read
