"""Pages made to mislead the main-text extraction."""

import time

import pytest

pytest.importorskip("public_tokenizers")

from memloom.llm import html_extract  # noqa: E402

LONG = "After three days of rain the river rose above the old bridge and the town waited for the morning. "
SHORT = "Opening words of this short piece."


@pytest.mark.parametrize("tag", ["nav", "menu", "form", "fieldset", "legend", "button", "label", "dialog", "aside", "footer"])
def test_menus_and_forms_inside_an_article_go(tag):
    text = html_extract.extract(f"<body><nav>Home</nav><article><p>{LONG * 3}</p><{tag}>Drop these words now</{tag}><p>Second {LONG * 3}</p></article><footer>End</footer></body>")
    assert text.startswith("After three") and "Second" in text and "Drop" not in text and "Home" not in text


@pytest.mark.parametrize("between", ["<figure><img></figure>" * 20, "<span></span>" * 60, "<x-y></x-y>" * 60, "<ul>" + "<li><a href='/x'>Item</a></li>" * 40 + "</ul>"])
@pytest.mark.parametrize("frame", ["article", "div"])
def test_tags_without_text_cost_no_text(between, frame):
    text = html_extract.extract(f"<body><{frame}><p>{SHORT}</p>{between}<p>{LONG * 3}</p></{frame}><footer>f</footer></body>")
    assert text.startswith(SHORT) and text.endswith("morning.")


def test_a_head_without_its_end():
    text = html_extract.extract(f"<html><head><title>T</title><body><header><h1>Site</h1></header><article><header><h1>Title words</h1></header><p>{LONG * 2}</p></article></body>")
    assert text.startswith("Title words\n")


@pytest.mark.parametrize("name", ["notice-period", "share-price", "social-science", "search-algorithm", "reply-letter", "comment-on-text", "copyright-law", "post-header"])
def test_names_that_only_sound_like_boilerplate(name):
    assert "Kept sentence" in html_extract.extract(f"<body><article><p>{LONG}</p><div class='{name}'><p>Kept sentence of the article.</p></div><p>{LONG}</p></article></body>")


@pytest.mark.parametrize("name", ["ad", "sidebar", "comments", "newsletter", "share-buttons", "cookie-banner", "comment-list", "ad-slot", "related-posts"])
def test_names_of_boilerplate(name):
    assert "Dropped" not in html_extract.extract(f"<body><article><p>{LONG}</p><div class='{name}'><p>Dropped sentence of it.</p></div><p>{LONG}</p></article></body>")


def test_time_is_linear_in_names():
    page = "".join(f"<div class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>" for i in range(16_000)) + "x"
    start = time.time()
    assert html_extract.extract(page) == "x"
    assert time.time() - start < 2
