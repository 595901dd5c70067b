"""Cross-tokenizer alignment by a group dictionary.

A text with a space before it is encoded by a byte-level merge tokenizer (A) and by a sentencepiece merge model (B).
Byte offsets where a token of A and one of B both end cut the text into groups; a group is named by its ids,
``a1,a2|b1``. Two tokens are linked if their byte ranges overlap, which happens inside a group only.

Groups repeat, so each distinct one is looked at once:

1. Each task reads whole texts and closes a block after BYTES of them. A block interns its groups: a text is a list of
   numbers and frequencies, beside the block's dictionary of names. Both go to a written table.
2. Dictionaries are summed by name; each distinct group's links are listed once, with the group's frequency; sums by
   id pair give the pairs' counts, the largest by B id the best ones.
3. A group's sums over its links go back to the blocks' dictionaries by name, and from there to the texts by block.

Texts never cross the network, a block's rows are bounded, and no key holds more rows than there are blocks.
White space after another character starts a new unit: A starts a token there, and so does B, where no piece of
several characters holds that white space but at its start. Each worker keeps the last units it met, at most 2 * KEEP.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from memloom.llm import bpe
from memloom.llm.batches import bounded
from memloom.llm.scratch import Scratch

#: Bytes of text after which a block closes; kept units of a worker, none longer than LONGEST; dictionary rows of one Arrow batch; units looked at together.
BYTES, KEEP, LONGEST, ROWS, RUN = 6 << 20, 250_000, 64, 50_000, 1 << 18
#: Last two bytes of the characters that Unicode calls white space; others that end alike (a comma of Japanese, say) merely start no unit.
_WHITE_END = np.zeros(1 << 16, bool)
_WHITE_END[[high << 8 | low for low in (9, 10, 11, 12, 13, 32) for high in range(256)]] = True
_WHITE_END[[0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]] = True
DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {256 + i: b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the number of bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        alphabet = byte_alphabet()
        ranks = {entry.translate(alphabet).encode("latin-1"): i for entry, i in model["vocab"].items() if entry not in {t["content"] for t in spec["added_tokens"]}}
        merged = [ranks["".join(m if isinstance(m, list) else m.split(" ")).translate(alphabet).encode("latin-1")] for m in model["merges"]]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or merged != sorted(merged) or len(ranks) != 256 + len(merged):
            raise ValueError("a byte-level merge tokenizer is needed whose ids follow the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: raw for raw, i in ranks.items()}
        self.b, _ = bpe.loaded(b_path)
        self.b_bytes = {i: p.replace(bpe.SPACE, " ").encode() for i, p in enumerate(self.b.pieces)} | {i: bytes([b]) for i, b in self.b.byte_of.items()}
        self.a_size = {i: len(x) for i, x in self.a_bytes.items()}
        self.b_size = {i: len(x) for i, x in self.b_bytes.items()}
        self.starts = np.zeros(256, bool)
        self.starts[[ord(c) for c in " \t\n\v\f\r" if c not in self.b.mergeable]] = True
        self.fresh: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def named(self, unit: str) -> str:
        """The names of a unit's groups joined by ``;``. Empty if the tokens' bytes differ from the unit's."""
        left, right = self.a.encode_ordinary(unit), self.b.unit.findall(unit.replace(" ", bpe.SPACE))
        right = self.b.segment(right[0]) if len(right) == 1 and len(right[0]) > 1 else [i for u in right for i in self.b.unit_ids(u)]
        raw = unit.encode()
        if b"".join([self.a_bytes[i] for i in left]) != raw or b"".join([self.b_bytes[i] for i in right]) != raw:
            return ""
        a_size, b_size, out, a, b = self.a_size, self.b_size, [], [], []
        i = j = x = y = 0
        while i < len(left) or j < len(right):
            if x <= y:
                a.append(str(left[i]))
                x += a_size[left[i]]
                i += 1
            else:
                b.append(str(right[j]))
                y += b_size[right[j]]
                j += 1
            if x == y:
                out.append(f"{','.join(a)}|{','.join(b)}")
                a, b = [], []
        return ";".join(out)

    def name(self, unit: str) -> str:
        got = self.fresh.get(unit)
        if got is None:
            got = self.old.get(unit)
            if got is None:
                got = self.named(unit)
            if len(unit) <= LONGEST:
                if len(self.fresh) >= KEEP:
                    self.old, self.fresh = self.fresh, {}
                self.fresh[unit] = got
        return got


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Pair(a_path, b_path)
    return _LOADED[a_path, b_path]


class Block:
    """Whole texts whose groups are interned together."""

    def __init__(self, pair: Pair):
        self.pair, self.texts, self.size = pair, [], 0

    def add(self, text: str | None) -> None:
        # U+2581 in a text comes back as a space, so such a text has no tokens
        self.texts.append((" " + text).encode() if text and bpe.SPACE not in text else b"")
        self.size += len(self.texts[-1])

    def units(self) -> tuple[np.ndarray, pa.StringArray]:
        """The texts' bounds in units, and all units: white space after another character starts one."""
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum([len(t) for t in self.texts])
        at = np.flatnonzero(self.pair.starts[data])
        at = at[at > 1]
        at = at[~_WHITE_END[data[at - 2].astype(np.int32) << 8 | data[at - 1]]]
        first = np.zeros(len(data), bool)
        first[at] = True
        starts = np.concatenate(([0], ends))
        first[starts[starts < len(data)]] = True
        at = np.flatnonzero(first)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
        return np.searchsorted(at, starts), units

    def close(self) -> tuple[dict[str, np.ndarray], list[str], list[str], np.ndarray]:
        """Columns of the texts (``at``, ``times`` hold all texts' lists end to end, ``of`` their lengths), the texts' digests, the groups' names and frequencies."""
        bounds, units = self.units()
        coded = units.dictionary_encode()
        of, named = coded.indices.to_numpy(), [self.pair.name(u) for u in coded.dictionary.to_pylist()]
        n, size = len(self.texts), np.diff(bounds)
        if not all(named):
            odd = np.array([not x for x in named])[of]
            size[np.unique(np.repeat(np.arange(n), size)[odd])] = -1
            of, bounds = of[np.repeat(size >= 0, np.diff(bounds))], np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
            size = np.diff(bounds)
        spelled = pa.array([x + ";" for x in named], pa.large_string()).take(pa.array(of))
        chars = np.frombuffer(spelled.buffers()[1], np.int64)[bounds].tolist() if len(of) else [0] * (n + 1)
        spelled = memoryview(spelled.buffers()[2]) if len(of) else memoryview(b"")
        digests = [hashlib.sha256(spelled[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(chars, chars[1:])]
        interned: dict[str, int] = {}
        spread = [[interned.setdefault(g, len(interned)) for g in x.split(";")] if x else [] for x in named]
        names = list(interned)
        wide = np.array([len(x) for x in spread], np.int64)
        groups, starts = np.array([g for x in spread for g in x], np.int64), np.cumsum(wide) - wide
        a_ids, b_ids = (np.array([side.count(",") + 1 for side in sides], np.int64) for sides in (zip(*(g.split("|") for g in names)) if names else ((), ())))
        at, times, per = [], [], np.zeros(n, np.int64)
        first = 0
        while first < n:  # runs of texts, so that the spread lists stay small
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + RUN, side="right")) - 1)
            unit = of[bounds[first] : bounds[last]]
            reps = wide[unit]
            inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            owner = np.repeat(np.repeat(np.arange(last - first), size[first:last]), reps)
            met, count = np.unique(owner * len(names) + groups[np.repeat(starts[unit], reps) + inside], return_counts=True)
            owner, met = np.divmod(met, max(1, len(names)))
            per[first:last] = np.bincount(owner, minlength=last - first)
            at.append(met.astype(np.int32))
            times.append(count.astype(np.int32))
            first = last
        at, times = (np.concatenate([*x, np.empty(0, np.int32)]) for x in (at, times))
        owner = np.repeat(np.arange(n), per)
        total = lambda x: np.bincount(owner, weights=x, minlength=n).astype(np.int64)  # noqa: E731  exact below 2**53
        texts = {"n_a": total(times * a_ids[at]), "n_b": total(times * b_ids[at]), "n_groups": total(times), "of": per, "at": at, "times": times}
        texts["n_links"] = texts["n_a"] + texts["n_b"] - texts["n_groups"]  # no boundary inside a group is shared, so it has n_a + n_b - 1 links
        return texts, digests, names, np.bincount(at, weights=times, minlength=len(names)).astype(np.int64)


def interned(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """Rows of texts ``(block, id, n_a .. groups_sha256, at, times)`` and of dictionaries ``(block, at_group, name, n)``; the other columns are null."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("block", LongType()), StructField("id", kind), *StructType.fromDDL(DOCUMENT).fields, StructField("at", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType())), StructField("at_group", IntegerType()), StructField("name", StringType()), StructField("n", LongType())])
    names = schema.names

    def rows(number: int, ids: list[pa.Array], block: Block) -> Iterator[pa.RecordBatch]:
        texts, digests, groups, freq = block.close()
        n = len(block.texts)
        offsets = pa.array(np.concatenate(([0], np.cumsum(texts["of"]))).astype(np.int32))
        column = {"block": pa.array(np.full(n, number)), "id": pa.concat_arrays(ids), "groups_sha256": pa.array(digests, pa.string())}
        column |= {k: pa.array(texts[k]) for k in ("n_a", "n_b", "n_groups", "n_links")}
        column |= {k: pa.ListArray.from_arrays(offsets, pa.array(texts[k].astype(np.int32))) for k in ("at", "times")}
        types = {"at_group": pa.int32(), "name": pa.string(), "n": pa.int64(), "id": column["id"].type, "groups_sha256": pa.string(), "at": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}

        def batch(have: dict[str, pa.Array], size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(size, types.get(c, pa.int64())) for c in names], names)

        yield from pa.Table.from_batches([batch(column, n)]).to_batches(max_chunksize=2000)
        for i in range(0, len(groups), ROWS):
            part = groups[i : i + ROWS]
            have = {"block": np.full(len(part), number), "at_group": np.arange(i, i + len(part), dtype=np.int32), "n": freq[i : i + ROWS]}
            yield batch({k: pa.array(v) for k, v in have.items()} | {"name": pa.array(part, pa.string())}, len(part))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = loaded(a_path, b_path), TaskContext.get().partitionId() << 32
        block, ids = Block(pair), []
        for batch in batches:
            texts = batch.column(1)
            held = 0
            for i in range(batch.num_rows):
                block.add(texts[i].as_py())
                if block.size >= BYTES:
                    ids.append(batch.column(0).slice(held, i + 1 - held))
                    yield from rows(number, ids, block)
                    held, number, block, ids = i + 1, number + 1, Block(pair), []
            if held < batch.num_rows:
                ids.append(batch.column(0).slice(held))
        if block.texts:
            yield from rows(number, ids, block)

    bounded()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(read, schema)


def linked(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``groups(name, n)`` with ``links``: each linked id pair of the group and how often it holds the pair."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(a_path, b_path)
        a_size, b_size = pair.a_size, pair.b_size
        for batch in batches:
            a, b, times, offsets = [], [], [], [0]
            for name in batch.column(0).to_pylist():
                left, right = ([int(x) for x in side.split(",")] for side in name.split("|"))
                met: dict[tuple[int, int], int] = {}
                i = j = 0
                x, y = a_size[left[0]], b_size[right[0]]
                while True:
                    key = (left[i], right[j])
                    met[key] = met.get(key, 0) + 1
                    if x == y:  # the ends meet at the end of the group alone
                        break
                    if x < y:
                        i += 1
                        x += a_size[left[i]]
                    else:
                        j += 1
                        y += b_size[right[j]]
                for key, t in met.items():
                    a.append(key[0])
                    b.append(key[1])
                    times.append(t)
                offsets.append(len(a))
            struct = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (a, b, times)], ["a", "b", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["name", "n", "links"])

    return groups.select("name", "n").mapInArrow(read, "name string, n long, links array<struct<a:int,b:int,times:int>>")


def pair_counts(groups: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: how many links hold each id pair, and whether no pair with the same ``b`` has more."""
    pairs = groups.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum(F.col("n") * F.col("l.times")).alias("count"))
    top = pairs.groupBy(F.col("b").alias("tb")).agg(F.max("count").alias("top"))
    return pairs.join(top, F.col("b") == F.col("tb")).select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    ``a_path`` is a byte-level merge tokenizer's JSON file, ``b_path`` a sentencepiece model's, each on every executor;
    strings of special tokens inside a text are plain text. ``n_best``: links whose pair's count over all rows is the
    highest of its B id; ``count_sum``: the sum of the pairs' counts over the links. A null or empty text, and one whose
    joined token bytes differ from the text with a space before it (it holds U+2581), has zeros and an empty digest.
    Repeated rows count as often as they are there and come back repeated; a null id is kept; other columns are not read.
    Texts of any length are encoded whole. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "align")
    rows = scratch.save(interned(docs, id_col, text_col, a_path, b_path))
    entries = rows.filter("name is not null").select("block", "at_group", "name", "n")
    groups = entries.groupBy("name").agg(F.sum("n").alias("n"))
    groups = scratch.save(linked(groups, a_path, b_path).withColumn("group", F.monotonically_increasing_id()))
    pairs = scratch.save(pair_counts(groups))
    links = groups.select("group", F.explode("links").alias("l")).select("group", "l.*").join(pairs, ["a", "b"])
    sums = links.groupBy("group").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("count")).alias("sum"))
    scored = entries.select("block", "at_group", "name").join(groups.select("name", "group").join(sums, "group"), "name").select(F.col("block").alias("of"), "at_group", "best", "sum")
    kind = docs.schema[id_col].dataType
    out = StructType([StructField("id", kind), *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def joined(texts: pa.Table, groups: pa.Table) -> pa.Table:
        at, times = (texts.column(c).combine_chunks() for c in ("at", "times"))
        size = np.diff(at.offsets.to_numpy())
        owner = np.repeat(np.arange(texts.num_rows), size)
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        columns = {c: texts.column(c) for c in out.names if c in texts.column_names}
        number = groups.column("at_group").to_numpy()
        for name, source in (("n_best", "best"), ("count_sum", "sum")):
            value = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
            value[number] = groups.column(source).to_numpy()
            total = np.zeros(texts.num_rows, np.int64)
            np.add.at(total, owner, value[at] * times)
            columns[name] = pa.array(total)
        return pa.table([columns[c] for c in out.names], out.names)

    texts = rows.filter("name is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    found = texts.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(joined, out)
    return found.withColumnRenamed("id", id_col)
