"""Labelled pages for the main-text extraction: templates of several kinds, each filled with invented sentences.

The content of a page stands between START and END; what lies inside it but is none stands between CUT and RESUME.
"""

from __future__ import annotations

import itertools

START, END, CUT, RESUME = "\x02", "\x03", "\x04", "\x05"

#: What stands around the content, by the tag or the class, id or role it is named by; text comes where %s is.
MENUS = ["<nav><ul><li><a href='/a'>%s</a></li><li><a href='/b'>%s</a></li></ul></nav>", "<div class='menu'><a href='/a'>%s</a> | <a href='/b'>%s</a></div>", "<div class='nav'>%s</div>", "<ul id='navbar'><li>%s</li></ul>", "<div role='navigation'><a href='/a'>%s</a></div>", "<ol class='breadcrumb'><li>%s</li><li>%s</li></ol>", "<menu><li>%s</li></menu>", "<div class='toc'><a href='#a'>%s</a></div>", "<p class='breadcrumbs'>%s</p>", "<div class='pagination'><a href='/2'>%s</a></div>"]
HEADS = ["<header><h2>%s</h2><p>%s</p></header>", "<div id='header'><h1>%s</h1></div>", "<div class='masthead'>%s</div>", "<div role='banner'>%s</div>", "<div class='topbar'>%s</div>"]
ADS = ["<div class='ad'>%s</div>", "<div class='advert'><p>%s</p></div>", "<section class='banner promo'>%s</section>", "<div id='ads'>%s</div>", "<div class='advertisement'>%s</div>", "<div class='sponsored'><a href='/x'>%s</a></div>", "<ins class='adsbygoogle'>%s</ins>", "<div class='ad-slot'>%s</div>", "<div class='ad-container'>%s</div>"]
SIDES = ["<aside><h3>%s</h3><p>%s</p></aside>", "<div class='sidebar'><h3>%s</h3><ul><li>%s</li></ul></div>", "<div id='sidebar'>%s</div>", "<div class='related'><p>%s</p></div>", "<div class='widget'>%s</div>", "<div class='recommended'><a href='/r'>%s</a></div>", "<div role='complementary'><p>%s</p></div>", "<div class='share'><a href='/s'>%s</a></div>", "<div class='social'>%s</div>", "<div class='teaser'>%s</div>", "<div class='share-buttons'><a href='/s'>%s</a></div>", "<div class='related-posts'><p>%s</p></div>", "<div class='sidebar-left'>%s</div>", "<div class='widget-area'>%s</div>"]
NOTICES = ["<div class='cookie'><p>%s</p><button>%s</button></div>", "<div id='cookies'>%s</div>", "<div class='newsletter'><p>%s</p></div>", "<div class='popup'>%s</div>", "<div class='consent'>%s</div>", "<dialog><p>%s</p></dialog>", "<div class='notice'>%s</div>", "<div class='subscribe'>%s</div>", "<div class='gdpr'>%s</div>", "<div class='modal'>%s</div>", "<div class='cookie-banner'>%s</div>", "<div class='newsletter-box'><p>%s</p></div>", "<div class='notice-bar'>%s</div>"]
FORMS = ["<form><label>%s</label><input><p>%s</p></form>", "<div class='search'>%s</div>", "<div id='login'><p>%s</p></div>", "<fieldset><legend>%s</legend></fieldset>", "<button>%s</button>", "<label>%s</label>", "<div class='search-form'>%s</div>", "<fieldset><legend>%s</legend><label>%s</label></fieldset>"]
COMMENTS = ["<div id='comments'><h3>%s</h3><p>%s</p><p>%s</p></div>", "<section class='comments'><article><p>%s</p></article></section>", "<div class='comment'><p>%s</p></div>", "<ol class='replies'><li>%s</li><li>%s</li></ol>", "<div class='discussion'><p>%s</p></div>", "<div id='disqus'><p>%s</p></div>", "<div class='reply'>%s</div>", "<div class='comment-list'><p>%s</p></div>", "<div class='comments-section'><p>%s</p></div>"]
FOOTS = ["<footer>%s &middot; %s</footer>", "<div id='footer'><p>%s</p></div>", "<div role='contentinfo'>%s</div>", "<p class='copyright'>%s</p>", "<div class='imprint'>%s</div>"]
#: Frames of the content: what opens it, what closes it, and wordy pieces of no name before and after it.
FRAMES = [("<article>", "</article>", "", ""), ("<main>", "</main>", "", ""), ("<div class='post'>", "</div>", "", ""), ("<div>", "</div>", "", ""), ("<main><article>", "</article></main>", "", ""), ("<div id='content'>", "</div>", "", ""), ("<article>", "</article>", "<p>%s</p>", "<p>%s</p>"), ("<main>", "</main>", "<div>%s</div>", "<div><p>%s</p></div>"), ("<section>", "</section>", "", "")]
#: Bodies; those that only make sense in an article or main element come first.
INNER = ["<header><h1>%s</h1><p>%s</p></header><p>%s</p><blockquote>%s</blockquote><pre>%s</pre>" + CUT + "<footer>%s</footer>" + RESUME, "<div class='post-header'><h1>%s</h1></div><p>%s</p>{aside}<p>%s</p><figure><img></figure><figure><img></figure><details><summary>%s</summary><p>%s</p></details>", "<p>%s</p>{aside}<ul><li><a href='/1'>%s</a></li><li><a href='/2'>%s</a></li></ul><p>%s</p>"]
BODIES = [
    "<h1>%s</h1><p>%s</p><p>%s <b>%s</b> <a href='/t'>%s</a></p><ul><li>%s</li><li>%s</li></ul>",
    "<h1>%s</h1><p><b>%s<br>%s<p>%s</p><p>%s",
    "<h2>%s</h2><p>%s</p><table><tr><td>%s</td><td>%s</td></tr></table><figure><img><figcaption>%s</figcaption></figure><p>%s</p>",
    "<p>%s</p>{aside}<p>%s</p><h2>%s</h2><p>%s</p>",
    "<h1>Tea</h1><div class='lead'><p>Made fast.</p></div><p>%s</p><div><div>%s</div></div><div class='hint'>Mind it.</div><p>%s</p><div><p>The end.</p></div>",
    "<h1>%s</h1><section><h2>%s</h2><p>%s</p></section><section><h2>%s</h2><p>%s</p><dl><dt>%s</dt><dd>%s</dd></dl></section>",
]
SENTENCES = [
    "After three days of rain the river rose above the old bridge and the town waited for the morning.", "Flour and water are mixed and left to rest for a night in a cool room.", "The path leaves the village behind the church and climbs slowly through the beech wood.",
    "Trees close the veins of their leaves before the frost arrives.", "Street lamps can delay this for weeks.", "Time does most of the work, said the baker, and went back to the oven.", "What is left is blown away by the wind, and by spring new buds have formed.",
]
SHORT = ["Read our guide and save money today", "One", "All rights reserved by the owner", "Home", "I tried this at home and it was lovely", "Contact us", "We use cookies to make this site better for you", "Mine stayed flat, what did I do wrong?"]


def labelled_pages() -> list[str]:
    """One page for each boilerplate form at least, frames and bodies taken in turn; every page holds one form of each kind, the last inside the content where the body has room."""
    kinds = [MENUS, HEADS, ADS, SIDES, NOTICES, FORMS, COMMENTS, FOOTS]
    long, short = itertools.cycle(SENTENCES), itertools.cycle(SHORT)
    fill = lambda form, words: form if "%s" not in form else form % tuple(next(words) for _ in range(form.count("%s")))
    pages = []
    for i in range(max(map(len, kinds)) * 6):
        menu, head, ad, side, notice, form, comments, foot = (fill(k[i % len(k)], short) for k in kinds)
        start, end, lead, tail = FRAMES[i % len(FRAMES)]
        bodies = BODIES + INNER if "article" in start or "main" in start else BODIES
        body = fill(bodies[i % len(bodies)].replace("{aside}", CUT + (ad, side, notice, menu, form, comments)[i // 2 % 6] + RESUME), long)
        before = menu + ad + notice + fill(lead, long) if i % 2 else head + menu + notice + ad + fill(lead, long)
        pages.append(f"<html><head><title>{next(short)}</title><style>p{{margin:0}}</style></head><body>{before}{start}{START}{body}{END}{end}{fill(tail, long)}{side}{comments}{form}{foot}</body></html>")
    return pages
