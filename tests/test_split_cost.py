"""Splitting looks for headings and blank pieces only where there can be any."""

import random
import re

from memloom.operators import chunk


class Refuses:
    def search(self, text):
        raise AssertionError("looked through by a pattern")


def test_plain_text_needs_no_pattern(monkeypatch):
    text = "\n".join("words of a line that is cut " * 20 for _ in range(3)).replace(" \n", "\n").strip()
    want = chunk.split_one(text, "markdown", chunk.Bounds(60, overlap=15))
    monkeypatch.setattr(chunk, "_BLANK", Refuses())
    assert chunk.split_one(text, "markdown", chunk.Bounds(60, overlap=15)) == want and len(want) == 30


def test_blank_pieces_are_found_as_by_the_pattern():
    rng = random.Random(1)
    pattern = re.compile(r"(?:\A| )\s*(?= |\Z)")
    for _ in range(20_000):
        text = "".join(rng.choice("  ab\t\n\u00a0\u2003é\x0b\x1c\u200b") for _ in range(rng.randint(1, 7)))
        assert chunk.blank_piece(text) == (pattern.search(text) is not None), repr(text)
