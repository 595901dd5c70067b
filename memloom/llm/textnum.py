"""Numpy helpers shared by the text classifiers: blocks of UTF-8 bytes and rolling word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK, ROWS = 1 << 18, 256
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def blocks(texts: list[str | None], size: int = BLOCK, rows: int = ROWS) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of at most ``rows`` whole texts of about ``size`` bytes: (index of the first, texts as bytes). A longer text is a run of its own."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass") if isinstance(t, str) or t is None else b""
        if held and (total + len(raw) > size or len(held) == rows):
            yield first, held
            first, held, total = i, [], 0
        held.append(raw)
        total += len(raw)
    if held:
        yield first, held


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        both = []
        for base in (_P, inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.cumprod(out, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def fold(table: list[tuple[int, int]]) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for a, b in table:
        out[a] = b
    return out


class Hasher:
    """Hashes of byte ranges of one buffer, from prefix sums of byte * P**i."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            h ^= h >> np.uint64(33)
            h *= _MIX
            return h ^ (h >> np.uint64(29))


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
