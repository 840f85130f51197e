"""Layouts whose element names say advert, form or sidebar, against the plain reading of what was put in."""

import time

import pytest

from rollcall.llm import html_extraction

PROSE = [" ".join(f"Sentence {i} of paragraph {j} is prose, with commas, and it ends here." for i in range(5)) for j in range(6)]
OUTSIDE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>All pages</a></li></ul></nav>",
    "<div class='sidebar'><p>Most read this week in our sidebar.</p></div>",
    "<div class='cookie-notice'>We use cookies, please accept them.</div>",
    "<form class='newsletter' action='/s'><label>Mail</label><input name='m'><p>Subscribe to our newsletter.</p></form>",
    "<div id='comments'><div class='comment'><p>First! A reader comment.</p></div></div>",
    "<footer><p>Copyright of the paper.</p></footer>",
]
WRAPPERS = [
    ("<article>", "</article>"), ("<article class='post comments-open'>", "</article>"), ("<article class='entry share-enabled'>", "</article>"),
    ("<div class='layout sidebar-right'><article>", "</article></div>"), ("<div class='page no-sidebar'><div class='text'>", "</div></div>"),
    ("<form id='aspnetForm' method='post'><div class='content'>", "</div></form>"), ("<form><article>", "</article></form>"),
    ("<div class='post-with-share share'>", "</div>"), ("<div id='promotion-2024'>", "</div>"), ("<div class='related-work-page related'>", "</div>"),
    ("<div class='social'><div class='body'>", "</div></div>"), ("<main class='with-menu menu-left'>", "</main>"), ("<main><div class='overlay-root overlay'>", "</div></main>"),
    ("<div class='modal-open modal'><main>", "</main></div>"), ("<section class='alert-page alert'><div>", "</div></section>"),
    ("<div class='banner'><div class='sponsored'><div>", "</div></div></div>"), ("<div role='complementary'><div class='text'>", "</div></div>"),
    ("<table class='menu'><tr><td>", "</td></tr></table>"), ("<div class='header'><div class='story'>", "</div></div>"), ("<div class='login paywall'><section>", "</section></div>"),
    ("<div class='subscribe'><article>", "</article></div>"), ("<div id='notice-board' class='notice'>", "</div>"), ("<div class='pager'><div class='popup'><p>", "</p></div></div>"),
    ("<div class='disclaimer-law'><div>", "</div></div>"), ("<div class='recommended'><div><div>", "</div></div></div>"), ("<div class='toolbar-layout toolbar'>", "</div>"),
]


def read(page):
    return " ".join(html_extraction.main_blocks(html_extraction.blocks(page)))


@pytest.mark.parametrize("start, end", WRAPPERS)
def test_names_do_not_hide_the_article(start, end):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    page = f"<html><head><title>T</title></head><body>{OUTSIDE[0]}{start}{body}{end}{''.join(OUTSIDE[1:])}</body></html>"
    assert read(page) == " ".join(PROSE)


def test_a_heading_shows_where_the_article_is():
    body = "<h1>The heading of it</h1>" + "".join(f"<p>{p}</p>" for p in PROSE[:2])
    comments = "".join(f"<div class='comment'><p>{p}</p></div>" for p in PROSE * 5)
    page = f"<body>{OUTSIDE[0]}<div class='share post'>{body}</div><div id='comments'>{comments}</div></body>"
    assert read(page) == " ".join(["The heading of it", *PROSE[:2]])


def test_reader_comments_stay_out_however_long():
    comments = "".join(f"<article class='comment'><p>{p}</p></article>" for p in PROSE * 10)
    page = f"<body><article>{''.join(f'<p>{p}</p>' for p in PROSE[:3])}</article><section class='comments'>{comments}</section></body>"
    assert read(page) == " ".join(PROSE[:3])


def test_words_in_names_of_paragraphs():
    parts = [f"<p>{p}</p>" for p in PROSE]
    parts[2] = f"<p class='copyright-law'>{PROSE[2]}</p>"
    parts[4] = f"<blockquote class='share-holder'>{PROSE[4]}</blockquote>"
    advert = "<p class='advert'>Buy this fine thing, now, and save a lot.</p>"
    assert read(f"<body><article>{advert}{''.join(parts)}</article></body>") == " ".join(PROSE)


def test_inline_adverts_do_not_part_their_sentence():
    page = f"<body><article><p>{PROSE[0]} before <span class='ad'>AD</span> after</p><p>{PROSE[1]}</p></article></body>"
    assert read(page) == f"{PROSE[0]} before after {PROSE[1]}"


def test_time_is_linear_in_depth():
    def seconds(n):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            html_extraction.blocks("<div>" * n + "x " * 10 + "</div>" * n)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(16_000) < 20 * seconds(2_000) + 0.05
