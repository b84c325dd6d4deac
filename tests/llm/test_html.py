"""Main text of pages: against a template, a plain version of the scores, and ordinary shapes of pages."""

from __future__ import annotations

import html
import math
import re
import time
from html.parser import HTMLParser

import pytest

from meshloom.llm import htmltext, queries
from meshloom.llm.common import read_table

LARGEST = "/root/testdata/sf0.1"
PROSE = "Some text stands here, and it is fine. More of it follows, too, for a while."


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in read_table(spark, LARGEST, "pages").collect()}


def test_text_of_all_pages(spark, pages):
    """The pages have one template, so that the article can be cut out by hand."""
    got = {r.page_id: r.text for r in queries.op8_html_text(spark, LARGEST).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"(?s)<article>(.*)</article>", page)[1]
        want = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert got[i] == re.sub(r"\s+", " ", want).strip()


class Plain(HTMLParser):
    """Blocks of pages of the template: path, text, characters in links."""

    def __init__(self, page: str) -> None:
        super().__init__()
        self.path, self.blocks, self.text, self.linked, self.link = [], [], "", 0, False
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((tuple(self.path), text, min(self.linked, len(text))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.text += " "
        elif tag != "b" and tag != "meta":
            self.end()
            if self.path and self.path[-1] == "p":
                self.path.pop()
            self.path.append(tag + "".join(f".{v}" for k, v in attrs if k == "class"))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag != "b":
            self.end()
            while self.path and self.path.pop().split(".")[0] != tag:
                pass

    def handle_data(self, data):
        if not {"title", "style", "script"} & set(self.path):
            self.text += data
            self.linked += len(data) if self.link else 0


def plain_scores(blocks) -> list[float]:
    seen = [b for b in blocks if not {"nav", "footer"} & set(b[0])]

    def ratios(path):
        same = [(t, n) for p, t, n in blocks if p == path]
        chars, points = sum(len(t) - n for t, n in same), sum(sum(c in ".,;:!?…。，；：！？、" for c in t) for t, n in same if n < len(t))
        return chars / len(same), points / len(same)

    out = []
    for at, (path, text, n) in enumerate(seen):
        near = [(1 / (1 + abs(k - at)), ratios(seen[k][0])) for k in range(len(seen)) if abs(k - at) <= htmltext.REACH]
        chars, points = (sum(w * x[c] for w, x in near) / sum(w for w, _ in near) for c in (0, 1))
        out.append(math.sqrt(chars * (1 + points)) * (htmltext.LOWER if "div.ad" in path else 1))
    return out


def test_scores_against_a_plain_version(pages):
    for i in sorted(pages)[:300]:
        page = htmltext.read(pages[i])
        scores = [s for s, owner in zip(htmltext.path_scores(page), page.owner) if page.weight[owner]]
        assert scores == pytest.approx(plain_scores(Plain(pages[i]).blocks))


def article(page: str) -> str:
    found = re.search(r"(?s)<article>(.*)</article>", page)[1]
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", found)))).strip()


def nameless(page: str) -> str:
    """A page in which nothing but divisions and paragraphs tells its parts apart."""
    return re.sub(r' class="?[^" >]*"?', "", re.sub(r"<(/?)(nav|footer|article|ul|li)\b", r"<\1div", page))


def test_ratios_find_articles_without_names(pages, monkeypatch):
    """The article is found on pages of divisions alone; with the factor of tags and names in the place of scores, on none."""
    rows = [(article(p), nameless(p)) for p in list(pages.values())[:600]]
    got = [htmltext.main_text(p) for _, p in rows]
    assert all(g.endswith(a) for (a, _), g in zip(rows, got))  # at most the one line before it is taken for a part of it
    assert sum(g == a for (a, _), g in zip(rows, got)) > 0.7 * len(rows)
    monkeypatch.setattr(htmltext, "path_scores", lambda page: [page.weight[o] for o in page.owner])
    assert all(htmltext.main_text(p) != g for (_, p), g in zip(rows, got))


def test_scores_decide(monkeypatch):
    page = f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><a href=/x>About us</a></div>"
    assert htmltext.main_text(page) == f"{PROSE} {PROSE}"
    monkeypatch.setattr(htmltext, "path_scores", lambda page: [page.weight[o] for o in page.owner])
    assert htmltext.main_text(page).startswith("Home")


LINKS = "".join(f"<p><a href=/{k}>{PROSE}</a></p>" for k in range(6))
SIX = f"<p>{PROSE}</p>" * 6


@pytest.mark.parametrize("around", ["<form id='aspnetForm'>{}</form>", "<form class='form'>{}</form>", "<div class='post'>{}</div>", "<form><div id=c>{}</div></form>", "<body><header>{}</header>"])
def test_articles_in_other_elements(around):
    page = f"<nav><a href=/>Home</a></nav>{around.format(SIX)}<footer>End.</footer>"
    assert htmltext.main_text(page) == " ".join([PROSE] * 6)


@pytest.mark.parametrize("name", [
    "ad-1", "ad_300x250", "google-ad-unit-3", "advert-top-2", "ad-slot-1", "sponsored-content", "comment-thread", "comment-1", "share-buttons", "adBanner", "sidebar-2", "newsletter-box", "user-comments-list",
])
@pytest.mark.parametrize("inside", [True, False])
def test_names_of_boilerplate(name, inside):
    part = f"<div class='x {name}'><p>{PROSE}</p></div>"
    page = f"<article>{SIX}{part}</article>" if inside else f"<div>{SIX}</div>{part}"
    assert htmltext.main_text(page) == " ".join([PROSE] * 6)
    assert htmltext.main_text(page.replace("class", "id")) == " ".join([PROSE] * 6)


@pytest.mark.parametrize("name", ["adobe", "header-free", "no-ads", "shareholder", "commentary", "thread", "load-more-text", "reader", "has-comments"])
def test_names_that_say_nothing(name):
    assert htmltext.main_text(f"<div class={name}>{SIX}</div>") == " ".join([PROSE] * 6)


def test_what_stands_beside_content():
    six = " ".join([PROSE] * 6)
    assert htmltext.main_text(f"<nav>Menu</nav><article>{LINKS}</article><footer>End</footer>") == six
    assert htmltext.main_text(f"<div class=post>{SIX}<ul><li>One<li>Two</ul><pre>code here</pre></div><div class=respond><p>{PROSE}</p></div>") == f"{six} One Two code here"
    table = "<table><tr><td>a<td>b</table><ul><li><a href=x>A link</a></ul><pre>x = 1</pre>"
    assert htmltext.main_text(f"<div>{SIX}{table}</div><div><ul><li><a href=y>Other</a></ul></div>") == f"{six} a b A link x = 1"
    # boxes of links fall by their ratio, in an article too; boxes of text stay
    assert htmltext.main_text(f"<article><h1>T</h1><div><a href=1>Tweet</a> <a href=2>Mail</a></div>{SIX}<div>By hand.</div></article>") == f"T {six} By hand."
    two = f"<section>{SIX}</section><section><h2>More</h2>{SIX}{SIX}</section>"
    assert htmltext.main_text(f"<div><div><a href=/>Home</a></div>{two}</div>") == f"{six} More {six} {six}"
    assert htmltext.main_text("<div><a href=/1>One</a></div><div><a href=/2>Two</a></div>") == ""


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>x</title><body><p>{PROSE}</p></body>", PROSE),  # the head ends by itself
        (f'<div class="content with-sidebar"><p>{PROSE}</p></div><div class="sidebar"><p>{PROSE} Read also.</p></div>', PROSE),
        (f'<div class="post no-comments"><p>{PROSE}</p></div>', PROSE),
        (f'<div id="reader"><p>{PROSE}</p></div>', PROSE),
        (f'<body><h1>T</h1><p>Lead, here.</p><div class="body">{f"<p>{PROSE}</p>" * 10}</div><p>Closing.</p>', f"T Lead, here. {' '.join([PROSE] * 10)} Closing."),
        (f"<article><header><h1>Head</h1></header><figure><img src=x><figcaption>Caption</figcaption></figure><p>{PROSE}</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></article>", f"Head Caption {PROSE} One Two"),
        (f"<p title=it's>{PROSE}</p><p>{PROSE}</p>", f"{PROSE} {PROSE}"),
        (f"<form id=all><nav>Menu</nav><div><p>{PROSE * 4}</p></div><footer>End</footer></form>", PROSE * 4),
        ("<form><p>Your name</p></form>", ""),
        (f"<article><p>Tiny.</p></article><section id='comments'>{f'<article class=comment><p>{PROSE}</p></article>' * 9}</section>", "Tiny."),
        (f"<div><h2>A</h2><p>{PROSE * 4}</p><pre>{'x = 1; ' * 2000}</pre><p>{PROSE}</p></div>", f"A {PROSE * 4} {('x = 1; ' * 2000).strip()} {PROSE}"),
        (f"<table><tr><td><a href=1>Menu</a><td><p>{PROSE}<p>{PROSE}<tr><td>Cell</table>", f"{PROSE} {PROSE} Cell"),
        (f"<div class=cookie-notice><p>{PROSE}</p></div><p>a<img src=x>b &lt;c&gt; 1 < 2, it is &#233;.</p>", "ab <c> 1 < 2, it is é."),
        (f"<p>{PROSE}<!-- never closed <p>hidden", PROSE),
        (f"<p>{PROSE}<a href='x>not a quote</a>", f"{PROSE}not a quote"),
        ("<nav>Menu</nav><footer>End, of it all.</footer>", ""),
    ],
)
def test_shapes(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("more", ["</x>", "<li>", "<li></li>", "</p>", "<td>", "</li></ul>", "<dd>"])
def test_time_of_crafted_pages(more):
    """Time is in proportion to the page: four times a page may take ten times as long at most."""
    took = []
    for n in (8_000, 32_000):
        page = "<ul><li>" + "<div>" * n + more * n + PROSE
        began = time.perf_counter()
        assert PROSE in htmltext.main_text(page) or more == "<td>"
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_deep_and_long_pages():
    assert htmltext.main_text("<div>" * 20_000 + PROSE) == PROSE
    assert len(htmltext.main_text(f"<p>{PROSE}</p>" * 20_000)) == 20_000 * (len(PROSE) + 1) - 1
    assert htmltext.main_text("<" * 100_000).count("<") <= 100_000
