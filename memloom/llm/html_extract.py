"""Main-text extraction from web pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens: words score positive, tags negative. All weights are learned from the labelled pages
of ``html_pages``. A word weighs the chance that a word of its container is content, containers being told by
their tag and the words of their class, id and role; a tag weighs its log-odds against content at first, and tags
with no word between them weigh as much as the heaviest of them. Then, as long as the best region of a labelled page is
not its content, the weights of the tags between the two are moved, words staying positive and tags negative. One linear scan finds the contiguous region with the largest sum; inside
it, the text of containers that are more likely no content is left out and the rest is joined block by block.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.batches import bounded
from memloom.llm.html_pages import CUT, END, RESUME, START, labelled_pages

#: Elements without content, elements whose content is no text of the page, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg object select textarea title head canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose own name says nothing about what they hold.
PLAIN = frozenset("html body div span p a b i em strong ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 blockquote pre code small font center section".split())

_OPEN = re.compile(r"<([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_LOOSE = re.compile(r"<([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
_CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.DOTALL)
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")


class Container:
    """What a container adds to those around it: ``own``, the names that tell it, in groups of which all count or none."""

    __slots__ = ("own", "up", "article")

    def __init__(self, own: tuple[tuple[str, ...], ...], up: Container | None, article: bool):
        self.own, self.up, self.article = own, up, article

    def hints(self) -> set[str]:
        """The names of this container and of all around it."""
        out: set[str] = set()
        at: Container | None = self
        while at is not None:
            out.update(n for group in at.own for n in group)
            at = at.up
        return out


ROOT = Container((), None, False)


class Token(NamedTuple):
    """A piece of text (``tag`` empty) or a tag, and the container it stands in."""

    tag: str
    within: Container
    text: str


def contained(tag: str, attrs: str, up: Container) -> Container:
    """The container a tag opens: ``up`` itself, if its name and attributes say nothing.

    A container is told by its tag and by the words of its class, id and role; inside an article or main element both are told apart,
    by ``@article``. Of a name of several words the first and the last count there together, elsewhere each by itself.
    """
    at = "@article" if up.article else ""
    own = [] if tag in PLAIN else [(tag + at,)]
    if attrs and tag not in ("html", "body", "article", "main"):
        for m in _ATTR.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = _NAME.findall(name)
                ends = ["." + w + at for w in dict.fromkeys(words[:1] + words[-1:])]
                own += [tuple(ends)] if at and ends else [(e,) for e in ends]
    article = up.article or tag in ("article", "main")
    return Container(tuple(own), up, article) if own or article != up.article else up


def closing(lower: str, tag: str, start: int) -> int:
    """Where the next end tag of exactly this name begins; -1 without one."""
    at = lower.find("</" + tag, start)
    while at >= 0 and (lower[at + 2 + len(tag) : at + 3 + len(tag)].isalnum() or lower[at + 2 + len(tag) : at + 3 + len(tag)] in ("-", ":")) and at + 2 + len(tag) < len(lower):
        at = lower.find("</" + tag, at + 2)
    return at


def tokens(page: str) -> list[Token]:
    """The tokens in page order. A container ends at its end tag, or where an enclosing one ends. Contents of RAW elements are no tokens.

    Time grows with the page's length: what was searched once to the end without success is not searched again.
    """
    out: list[Token] = []
    stack: list[tuple[str, Container]] = [("", ROOT)]
    open_at: dict[str, list[int]] = defaultdict(list)
    missing: set[str] = set()
    quoted, at, size = True, 0, len(page)
    lower = page.lower() if len(page.lower()) == size else page
    while at < size:
        lt = page.find("<", at)
        follows = page[lt + 1 : lt + 2] if lt >= 0 else ""
        while lt >= 0 and not (follows.isascii() and follows.isalpha()) and follows not in ("!", "?", "/"):
            lt = page.find("<", lt + 1)
            follows = page[lt + 1 : lt + 2] if lt >= 0 else ""
        end = lt if lt >= 0 else size
        if end > at:
            out.append(Token("", stack[-1][1], page[at:end]))
        if lt < 0:
            break
        if follows.isalpha():
            m = _OPEN.match(page, lt) if quoted else None
            if m is None:
                quoted = quoted and page.find(">", lt) < 0  # quotes of this page do not pair: read tags up to the next ">"
                m = _LOOSE.match(page, lt)
            tag, attrs, at = m[1].lower(), m[2], m.end()
            if tag in RAW:
                out.append(Token(tag, stack[-1][1], ""))
                close = -1 if tag in missing else closing(lower, tag, at)
                if close >= 0:
                    at = page.find(">", close) + 1 or size
                else:
                    missing.add(tag)
                    if tag in ("script", "style"):
                        at = size
                continue
            hints = contained(tag, attrs, stack[-1][1])
            out.append(Token(tag, hints, ""))
            if tag == "p" and stack[-1][0] == "p":
                stack.pop()
                open_at["p"].pop()
                hints = contained(tag, attrs, stack[-1][1])
            if tag not in VOID and (tag in BLOCK or hints is not stack[-1][1]):
                open_at[tag].append(len(stack))
                stack.append((tag, hints))
            continue
        m = _CLOSE.match(page, lt)
        if m is None:
            at = _OTHER.match(page, lt).end()
            continue
        tag, at = m[1].lower(), m.end()
        hints = stack[-1][1]
        if open_at[tag]:
            depth = open_at[tag][-1]
            hints = stack[depth][1]
            for name, _ in stack[depth:]:
                open_at[name].pop()
            del stack[depth:]
        out.append(Token("/" + tag, hints, ""))
    return out


class Weights(NamedTuple):
    """``chance``: that a word in a container with a hint is content; ``tags``: the scores of tags."""

    chance: dict[str, float]
    tags: dict[str, float]


UNSEEN_TAG, MOST_AT_FIRST, LEAST = -0.1, -0.5, 0.01


def own_chance(box: Container, chance: dict[str, float]) -> float:
    """The smallest chance among a container's own names.

    A name inside an article that no labelled page has counts as it does elsewhere. Where names count
    together, one that no page has at all takes the others' word away: a ``share-price`` is no ``share``.
    """
    least = 1.0
    for group in box.own:
        known = [chance.get(n, chance.get(n.removesuffix("@article"))) for n in group]
        if None not in known:
            least = min(least, *known)
    return least


class Chances(dict):
    """Container → the smallest chance of its own names and of those around it; each is looked at once."""

    def __init__(self, chance: dict[str, float]):
        self.chance = chance

    def __missing__(self, box: Container) -> float:
        todo = [box]
        while todo[-1].up is not None and todo[-1].up not in self:
            todo.append(todo[-1].up)
        for b in reversed(todo):
            own = own_chance(b, self.chance)
            self[b] = own if b.up is None else min(own, self[b.up])
        return self[box]


def scores(found: list[Token], weights: Weights, held: Chances | None = None) -> list[float]:
    """A word's chance for each word of a text; for tags in a row the heaviest one's weight, on the first of them."""
    held = Chances(weights.chance) if held is None else held
    out: list[float] = []
    run = -1
    for t in found:
        if t.text:
            words = len(t.text.split())
            out.append(words * max(LEAST, held[t.within]))
            if words:
                run = -1
        else:
            weight = weights.tags.get(t.tag, UNSEEN_TAG)
            if run < 0:
                run = len(out)
                out.append(weight)
            else:
                out[run] = min(out[run], weight)
                out.append(0.0)
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    return best_from, best_to


def fit(pages: list[str], rounds: int = 100) -> Weights:
    """Chances from word counts; tags from log-odds, then moved until each page's best region covers its content and no other words that count."""
    inside, outside, tag_in, tag_out = (defaultdict(float) for _ in range(4))
    known: list[tuple[list[Token], list[bool]]] = []
    for page in pages:
        found, within, cut, flags = [], False, False, []
        for t in tokens(page):
            for piece in re.split(f"([{START}{END}{CUT}{RESUME}])", t.text) if t.text else [""]:
                if piece in (START, END):
                    within = piece == START
                elif piece in (CUT, RESUME):
                    cut = piece == CUT
                elif piece or not t.text:
                    found.append(t._replace(text=piece))
                    flags.append(within)
                    if piece:
                        for h in t.within.hints():
                            (inside if within and not cut else outside)[h] += len(piece.split())
                    else:
                        (tag_in if within else tag_out)[t.tag] += 1
        known.append((found, flags))
    chance = {h: (inside[h] + 0.05) / (inside[h] + outside[h] + 0.1) for h in inside.keys() | outside.keys()}
    tags = {t: min(-0.1, math.log((tag_in[t] + 0.5) / (tag_out[t] + 0.5)) - 0.2) for t in tag_in.keys() | tag_out.keys()}
    held = Chances(chance)
    weights = Weights(chance, {t: max(MOST_AT_FIRST, w) for t, w in tags.items()})
    for _ in range(rounds):
        moved = False
        for found, flags in known:
            a, b = best_region(scores(found, weights, held))
            taken = [a <= i < b for i in range(len(found))]
            if all(w == f for w, f, t in zip(taken, flags, found, strict=True) if t.text.strip() and held[t.within] >= 0.5):
                continue
            moved = True
            for t in {t.tag for t, w, f in zip(found, taken, flags, strict=True) if not t.text and f and not w}:
                weights.tags[t] = min(-0.1, weights.tags[t] + 0.25)
            for t in {t.tag for t, w, f in zip(found, taken, flags, strict=True) if not t.text and w and not f}:
                weights.tags[t] -= 0.5
        if not moved:
            break
    return weights


WEIGHTS = fit(labelled_pages())


def extract(page: str | None, weights: Weights = WEIGHTS) -> str:
    """The text of the best region, one block a line."""
    found = tokens(page or "")
    chances = Chances(weights.chance)
    a, b = best_region(scores(found, weights, chances))
    out: list[str] = []
    held: list[str] = []
    for t in found[a:b]:
        if t.text:
            if chances[t.within] >= 0.5:
                held.append(html.unescape(t.text))
        elif t.tag.lstrip("/") in BLOCK:
            out.append(" ".join("".join(held).split()))
            held = []
    out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)


def extract_column(page: Column) -> Column:
    """Main text of a page; null pages give the empty text."""
    bounded()

    @F.pandas_udf("string")
    def udf(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages], dtype=object)

    return udf(page)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null or empty pages, and pages without words outside boilerplate, give the empty text and
    0 characters. Pages of any length are read whole, and cut-off pages as far as they go. Repeated rows
    come back repeated. A page with several marked regions gives one text if each has more words than the marks between them
    cost (about 40), else the largest region alone.
    """
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract_column(F.col(html_col)).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
