"""Pages whose article must not be lost, and pages that must not take long."""

import resource
import time

import pytest

from cohortspark.llm import extraction

BODY = [f"Paragraph {k} of the story tells at some length what happened on that day in the town." for k in range(6)]
PARAS = "".join(f"<p>{b}</p>" for b in BODY)
NAV = "<nav><a href=/>Home</a> <a href=/b>More</a></nav><div class=menu><ul><li><a href=/c>One</a><li><a href=/d>Two</a></ul></div>"
FOOT = "<div class=newsletter><form><p>Sign up for our letter</p><input></form></div><footer>All rights</footer>"


@pytest.mark.parametrize("page", [
    "<body><form id=aspnetForm method=post>{nav}<div id=content><h1>Title</h1>{text}</div>{foot}</form>",
    "<body><form id=aspnetForm>{nav}<article><h1>Title</h1>{text}</article>{foot}</form>",
    '<body style="display:none">{nav}<article><h1>Title</h1>{text}</article>{foot}',
    '<html hidden><body>{nav}<article><h1>Title</h1>{text}</article>{foot}',
    '<body><div aria-hidden="true">{nav}<article><h1>Title</h1>{text}</article></div>{foot}',
    '<body>{nav}<article><h1>Title</h1>{text}<div style="display: none">A hidden remark of some words that nobody sees.</div></article>{foot}',
    '<body>{nav}<article><h1>Title</h1>{text}<form><p>Write to us about this story</p><textarea>x</textarea></form></article>{foot}',
    '<body>{nav}<article><h1>Title</h1>{text}<div class=related><a href=/x>Another story of the day</a></div><div class="share">Share</div></article>{foot}',
    '<body>{nav}<article><h1>Title</h1>{text}<aside>Side remark</aside><div class=comments><p>I like this story a lot, well done to all.</p></div></article>{foot}',
])
def test_the_article_is_whole(page):
    got = extraction.main_text(page.format(nav=NAV, text=PARAS, foot=FOOT))
    assert got.split("\n") == ["Title", *BODY]


def test_text_of_an_article_by_names_of_widgets():
    page = f"<body>{NAV}<article><h1>Title</h1><p class=share>{BODY[0]}</p><div class=promotion>{''.join(f'<p>{b}</p>' for b in BODY[1:4])}</div><section id=related><h2>Related work</h2>{PARAS}</section></article>{FOOT}"
    assert extraction.main_text(page).split("\n") == ["Title", *BODY[:4], "Related work", *BODY]


@pytest.mark.parametrize("page", [
    "<div>x y" * 60_000, "<b>" * 100_000 + "</i>" * 100_000, "<a " * 200_000, "<i><article>" + "<b>" * 100_000 + "</i>" * 100_000,
    "<b>" * 100_000 + "<h1></h1>" * 50_000, "<article>x " * 60_000, "<div class=ad>x " * 50_000, "<p>x<b>y" * 60_000, "<!" * 300_000,
    "<h1>x</h1><div>" * 40_000 + "z " * 300 + "</div>" * 40_000, "<td><table>x" * 50_000, '<a href="' * 60_000, "&amp" * 250_000, "<" * 500_000,
], ids=lambda p: p[:18])
def test_time_and_memory_grow_with_the_page(page):
    start, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    extraction.main_text(page)
    assert time.process_time() - start < 12
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
