"""Exact merge-type encoding and decoding with a sentencepiece model, by backtracking.

At each place the longest piece is taken (an Aho-Corasick automaton over the pieces); a
piece may follow its neighbour only if merging the two pieces' text from single characters
gives these two pieces back; places that cannot be completed are marked in a bit field and
the search steps back. A sequence whose neighbours all agree is the merge result itself,
since merges inside one pair do not depend on what stands beside it.

No piece holds a space mark after another character, so a text splits before each run of
space marks into units that never merge with each other; characters outside every piece of
two or more characters split units further. Units repeat, so each worker keeps the last
ones it met, at most 2 * KEEP of them, while a task lasts. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.llm.batches import bounded

SPACE = "▁"
KEEP = 100_000
NORMAL, BYTE = 1, 6


class Model:
    """Pieces, scores and byte tokens of a sentencepiece BPE file (identity normalisation, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            spec = proto.ModelProto.FromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a merge-type model with identity normalisation, a dummy prefix and all white space kept is needed")
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == 3}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == 2)
        self.surface = spec.trainer_spec.unk_surface
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.mergeable = {c for p in self.ids if len(p) > 1 for c in p}
        if not self.mergeable <= self.ids.keys():
            raise ValueError("a character of a piece is no piece itself")
        #: Every path of the automaton → the longest piece on it; each piece → the next shorter one.
        self.floor: dict[str, int] = {}
        self.shorter = [-1] * len(self.pieces)
        for p in self.ids:
            for n in range(1, len(p) + 1):
                if p[:n] not in self.floor:
                    self.floor[p[:n]] = next((self.ids[p[:k]] for k in range(n, 0, -1) if p[:k] in self.ids), -1)
        for p, i in self.ids.items():
            self.shorter[i] = self.floor[p[:-1]] if len(p) > 1 else -1
        self.length = [len(p) for p in self.pieces]
        #: No piece is longer, so no search looks further.
        self.longest = max(map(len, self.ids), default=1)
        solid = "".join(re.escape(c) for c in sorted(self.mergeable - {SPACE}))
        #: Space marks with the mergeable characters after them, or any other single character.
        self.unit = re.compile(f"{SPACE}*[{solid}]+|{SPACE}+|.", re.DOTALL)
        #: Words of mergeable characters alone: one unit, which decodes to itself.
        self.solid = re.compile(f"[{solid}]+")
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge single characters, the best-scored pair first and the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: int, right: int) -> bool:
        """Whether merging both pieces' text gives the two back; ``right`` -1: whether ``left`` alone does."""
        if len(self.pairs) > 2 * KEEP:
            self.pairs.clear()
        parts = [self.pieces[i] for i in (left, right) if i >= 0]
        got = self.pairs[left << 20 | right + 1] = self.merged("".join(parts)) == parts
        return got

    def segment(self, text: str) -> list[int]:
        """Ids of a unit of mergeable characters."""
        floor, length, shorter, pairs, deepest = self.floor, self.length, self.shorter, self.pairs, self.automaton.longest_prefix
        size, at, last, out, longest = len(text), 0, -1, [], self.longest
        failed = bytearray(size + 1)
        piece = floor[text[: deepest(text)]]
        while True:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end]:
                    key = last << 20 | piece + 1 if last >= 0 else piece << 20
                    ok = pairs.get(key)
                    if ok is None:
                        ok = self.agree(last, piece) if last >= 0 else self.agree(piece, -1)
                    if ok:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == size:
                    return out
                at, last = end, piece
                rest = text[at : at + longest]
                piece = floor[rest[: deepest(rest)]]
            else:
                failed[at] = 1
                piece = shorter[last]
                at -= length[last]
                out.pop()
                last = out[-1] if out else -1

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of one unit; a character that is no piece becomes its UTF-8 bytes."""
        if len(unit) > 1 or unit in self.mergeable:
            return self.segment(unit)
        if unit in self.ids:
            return [self.ids[unit]]
        return [self.bytes[b] for b in unit.encode("utf-8", "replace")]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; none for the empty text."""
        if not text:
            return []
        return [i for unit in self.unit.findall(SPACE + text.replace(" ", SPACE)) for i in self.unit_ids(unit)]

    def decode_raw(self, ids: Iterable[int]) -> str:
        """Text of ids with space marks as spaces, before the dummy prefix goes."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(utf8(pending))
                pending = bytearray()
            out.append("" if i in self.silent else self.surface if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out) + utf8(pending)

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        head = next((i for i in ids if i not in self.silent), None)
        text = self.decode_raw(ids)
        return text[1:] if head is not None and head not in self.byte_of and self.pieces[head].startswith(SPACE) else text


def utf8(data: bytes) -> str:
    """Decode; each byte that belongs to no character becomes one replacement character."""
    out, rest = [], bytes(data)
    while rest:
        try:
            return "".join(out) + rest.decode("utf-8")
        except UnicodeDecodeError as e:
            out += [rest[: e.start].decode("utf-8"), "�"]
            rest = rest[e.start + 1 :]
    return "".join(out)


class Units(dict):
    """Unit → (ids as text, decoded text); two generations, so that units in use stay."""

    def __init__(self, model: Model):
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        got = self.old.get(word)
        if got is None:
            unit, model = SPACE + word, self.model
            if model.solid.fullmatch(word):
                got = (",".join(map(str, model.segment(unit))), " " + word)
            else:
                ids = [i for u in model.unit.findall(unit) for i in model.unit_ids(u)]
                got = (",".join(map(str, ids)), model.decode_raw(ids))
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


_LOADED: dict[str, tuple[Model, Units]] = {}


def loaded(path: str) -> tuple[Model, Units]:
    if path not in _LOADED:
        model = Model(path)
        _LOADED[path] = (model, Units(model))
    return _LOADED[path]


def digest(text: str | None, model: Model, units: Units) -> tuple[int, str, str]:
    """``(n_tokens, sha256 of the ids joined by commas, sha256 of the decoded text)``."""
    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
    if text:
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            words = spaced(text)
        else:
            words = text.split(" ")
        for at in range(0, len(words), 50_000):
            got = [units[w] for w in words[at : at + 50_000]]
            ids = ",".join([g[0] for g in got])
            n += ids.count(",") + 1
            plain = "".join([g[1] for g in got])
            ids_sha.update((ids if at == 0 else "," + ids).encode())
            text_sha.update((plain[1:] if at == 0 and plain[:1] == " " else plain).encode("utf-8", "replace"))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def digests(batches: Iterable[pd.Series], path: str) -> Iterator[pd.DataFrame]:
    """``digest`` of each text. Units and pairs go at the end, as a worker outlives its task and the memory is then another step's."""
    model, units = loaded(path)
    try:
        for texts in batches:
            yield pd.DataFrame([digest(t, model, units) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    finally:
        units.clear()
        units.old = {}
        model.pairs.clear()


def spaced(text: str) -> list[str]:
    """Units without their first space mark, where several marks meet."""
    return [u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]


def encode_digest_column(text: Column, path: str) -> Column:
    """``struct(n_tokens, ids_sha256, decoded_sha256)``; ``path`` is the model's, on each executor.

    Null text counts as empty: 0 tokens and the digests of nothing. Texts are encoded whole, 50,000 words at a time.
    """
    bounded()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from digests(batches, path)

    return udf(text)


def encode_column(text: Column, path: str) -> Column:
    """The ids as ``array<int>``; null text counts as empty."""
    bounded()

    @F.pandas_udf("array<int>")
    def udf(texts: pd.Series) -> pd.Series:
        model, _ = loaded(path)
        return pd.Series([model.encode(t or "") for t in texts])

    return udf(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an ``array<int>``; null counts as empty."""
    bounded()

    @F.pandas_udf("string")
    def udf(rows: pd.Series) -> pd.Series:
        model, _ = loaded(path)
        return pd.Series([model.decode([] if r is None else r) for r in rows])

    return udf(ids)
