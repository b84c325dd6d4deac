"""Main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each under a path of tags from the root to the block.
For each path, text and punctuation outside links are added up and divided by the number of
its blocks. The two ratios are smoothed over neighbouring blocks and fused; boilerplate tags
and names on the way to a block lower its score. Blocks over the threshold are content. The
deepest element with most of their text is the content node: what stands there beside
content is main text too, however short, unless it is lowered or is a box of links, and so
is what stands in a row with the node in plain paragraphs and headings.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of HTML.
#: Elements whose content is not text of the page.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "noframes")
#: Elements without content, of which the first few stand in a line of text.
VOID = frozenset("img input embed wbr area base br col hr link meta param source track".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " img input embed wbr".split()
)
#: Elements that a new one of the group ends, and those that hold such groups.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = frozenset("ul ol menu dl select table article main".split())
#: Elements that never hold main text, and those that do so only around a whole page.
NEVER = frozenset("nav footer aside menu dialog button select option".split())
SELDOM = frozenset("form header".split())
#: Elements that hold the article, whatever their names say.
MAIN = frozenset("main article".split())
ROOT = frozenset("html head body".split())
#: Elements of running text, which stand for themselves beside content; others are boxes.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption details summary address".split())
#: Nouns at the end of a class, id or role that name boilerplate, notices and readers' comments, and those that do so wherever they stand.
NOUNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer"
    " sidebar aside widget widgets related recommended share sharing social comment comments commentlist disqus replies notice notices cookie cookies consent gdpr"
    " popup modal overlay newsletter subscribe signup login search form copyright complementary contentinfo alert dialog alertdialog respond".split()
)
ANYWHERE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments share sharing".split())
#: Words that may follow such a noun, and words before it that say that something is only there, or isn't.
PARTS = frozenset("list area section box container wrapper wrap block slot unit bar banner links left right top bottom inner outer items item panel body holder".split())
MODIFIERS = frozenset("no not without with has have is show hide non free".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
#: Neighbours on each side over which ratios are smoothed.
REACH = 2
#: Share of the best score that makes a path content, and share of its text that the content node holds.
CUT, HOLD = 0.45, 0.8
#: Factor on a score for a tag or name that speaks against main text, and the score that a form or header needs to be content all the same.
LOWER, LEAST = 0.001, 0.012


@dataclass
class Page:
    """Elements in page order, the first being the root, and text blocks, by their element."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])  # equal for equal tag paths
    weight: list[float] = field(default_factory=lambda: [1.0])
    main: list[int] = field(default_factory=lambda: [0])  # the outermost main element above, if any
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of link text
    owner: list[int] = field(default_factory=list)


def _named(value: str) -> bool:
    """Whether one name of a class, id or role means boilerplate."""
    words = re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().strip("-_"))
    words = [w for w in words if not re.fullmatch(r"\d+(?:x\d+)?", w)]
    if not words or MODIFIERS.intersection(words):
        return False
    return words[-1] in NOUNS or (words[0] in NOUNS and PARTS.issuperset(words[1:])) or not ANYWHERE.isdisjoint(words)


def _weight(tag: str, attributes: str, inside_main: bool) -> float:
    """Factor that an element puts on the scores of what it holds."""
    if tag in NEVER:
        return 0.0
    names = [x for a in ATTRIBUTE.findall(attributes) for x in "".join(a[1:]).split()] if "=" in attributes else []
    if tag == "form":  # its names say what it is anyhow
        return LOWER
    return LOWER if (tag in SELDOM and not inside_main) or (tag not in MAIN and any(map(_named, names))) else 1.0


def read(page: str) -> Page:
    """Elements and blocks of a page. References are decoded, and white space is one space within a block."""
    out, known = Page(), {}
    path = [0]
    opened: dict[str, list[int]] = {}  # depths of the open elements of a name, and of all that hold groups
    holders: list[int] = []
    parts: list[str] = []
    linked, link, at = 0, 0, 0  # link: depth of the open link's place, and one more

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                out.text.append(text)
                out.linked.append(min(linked, len(text)))
                out.owner.append(path[-1])
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link:
                linked += len(text)

    def close(depth: int) -> None:
        nonlocal link
        for k in range(len(path) - 1, depth - 1, -1):
            opened[out.tag[path[k]]].pop()
        while holders and holders[-1] >= depth:
            holders.pop()
        del path[depth:]
        if link > len(path):
            link = 0

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in ROOT:
            continue
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if m[1] else len(path)
            continue
        flush()
        if name in VOID:
            continue
        if m[1]:
            if opened.get(name):
                close(opened[name][-1])
            continue
        if out.tag[path[-1]] == "p":
            close(len(path) - 1)
        if name in ENDED:  # the outermost of the group that is still within the same holder
            above = holders[-1] if holders else 0
            own = [depths[k] for tag in ENDED[name] if (depths := opened.get(tag)) and (k := bisect_right(depths, above)) < len(depths)]
            if own:
                close(min(own))
        above, own = path[-1], len(out.tag)
        names = " ".join(sorted(x for a in ATTRIBUTE.findall(m[3]) for x in "".join(a[1:]).split())) if "=" in m[3] else ""
        out.parent.append(above)
        out.tag.append(name)
        out.path.append(known.setdefault((out.path[above], name, names), len(known) + 1))
        out.weight.append(1.0 if name == "main" else out.weight[above] * _weight(name, m[3], out.main[above] > 0))
        out.main.append(out.main[above] or (own if name in MAIN else 0))
        opened.setdefault(name, []).append(len(path))
        if name in HOLDERS:
            holders.append(len(path))
        path.append(own)
    add(page[at:])
    flush()
    return out


def path_scores(page: Page) -> list[float]:
    """Score of each block: its path's ratios, smoothed over neighbours, fused, and lowered by links (of the path and its own) and names.

    Blocks in elements that never hold main text have score 0 and are nobody's neighbours.
    """
    sums: dict[int, list[int]] = {}
    for text, linked, owner in zip(page.text, page.linked, page.owner):
        s = sums.setdefault(page.path[owner], [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text) - linked
        s[2] += len(PUNCTUATION.findall(text)) if linked < len(text) else 0
        s[3] += len(text)
    out = [0.0] * len(page.text)
    open_ = [i for i, owner in enumerate(page.owner) if page.weight[owner]]
    of = [sums[page.path[page.owner[i]]] for i in open_]
    for at, (i, s) in enumerate(zip(open_, of)):
        size = chars = points = 0.0
        for k in range(max(at - REACH, 0), min(at + REACH + 1, len(of))):
            w = 1 / (1 + abs(k - at))
            size, chars, points = size + w, chars + w * of[k][1] / of[k][0], points + w * of[k][2] / of[k][0]
        plain = s[1] / s[3] * (1 - page.linked[i] / len(page.text[i]))
        against = LOWER if COPYRIGHT.match(page.text[i]) else 1.0
        out[i] = math.sqrt(chars / size * (1 + points / size)) * plain * page.weight[page.owner[i]] * against
    return out


def content(page: Page, scores: list[float]) -> list[bool]:
    """Whether each block belongs to the main text."""
    best, weight = max(scores, default=0.0), [page.weight[owner] for owner in page.owner]
    core = [s > 0 and s >= CUT * best and (w == 1.0 or (s >= LEAST and _only_seldom(page, o))) for s, w, o in zip(scores, weight, page.owner)]
    if not any(core):
        # text in links alone is main text only where an element says so
        return [w == 1.0 and page.main[o] > 0 and not COPYRIGHT.match(t) for w, o, t in zip(weight, page.owner, page.text)]
    # text of content, all text and link text of each element; a parent stands before what it holds
    held, whole, linked = [0] * len(page.tag), [0] * len(page.tag), [0] * len(page.tag)
    for text, n, owner, yes in zip(page.text, page.linked, page.owner, core):
        held[owner] += (len(text) - n) * yes
        whole[owner] += len(text)
        linked[owner] += n
    for k in range(len(page.tag) - 1, 0, -1):
        for sums in (held, whole, linked):
            sums[page.parent[k]] += sums[k]
    # elements with that much text of content lie in each other; the last is the deepest
    node = max(k for k in range(len(page.tag)) if held[k] >= HOLD * held[0])
    node = page.main[node] or node
    inside, around, box = [False] * len(page.tag), {0}, [0] * len(page.tag)
    inside[node] = True
    up = node
    while up:
        up = page.parent[up]
        around.add(up)
    for k in range(1, len(page.tag)):
        inside[k] = inside[k] or inside[page.parent[k]]
        box[k] = box[page.parent[k]] if page.tag[k] in PROSE else k
    low, high = core.index(True), len(core) - 1 - core[::-1].index(True)
    keep = []
    for i, (owner, w) in enumerate(zip(page.owner, weight)):
        links = 2 * page.linked[i] > len(page.text[i])
        if core[i]:
            ok = w >= page.weight[node]
        elif not inside[owner] or w < page.weight[node]:
            ok = False
        elif node == 0:  # the page itself: menus stand there as well
            ok = (held[box[owner]] > 0 and not links) or (low <= i <= high and 2 * linked[box[owner]] <= whole[box[owner]])
        else:
            ok = box[owner] == node or held[box[owner]] > 0 or page.tag[owner] in PROSE or 2 * linked[box[owner]] <= whole[box[owner]]
        keep.append(ok)
    # on from the node, as long as text stands in a row with it or what it is in
    beside = [box[o] in around and not inside[o] and w == page.weight[node] and 2 * n <= len(t) and page.tag[o] in PROSE and not COPYRIGHT.match(t)
              for o, w, n, t in zip(page.owner, weight, page.linked, page.text)]
    own = [i for i, yes in enumerate(keep) if yes]
    for at, step in ((own[0] - 1, -1), (own[-1] + 1, 1)) if own else ():
        while 0 <= at < len(keep) and beside[at]:
            keep[at] = True
            at += step
    return keep


def _only_seldom(page: Page, element: int) -> bool:
    """Whether nothing but one form or header lowers what an element holds."""
    lowered = 0
    while element:
        above = page.parent[element]
        if page.weight[element] < page.weight[above]:
            lowered += 1
            if page.tag[element] not in SELDOM:
                return False
        element = above
    return lowered == 1


def main_text(page: str | None) -> str:
    """Main text of a page; empty for null, for a page without text, and for one of boilerplate only."""
    found = read(page or "")
    return " ".join(t for t, keep in zip(found.text, content(found, path_scores(found))) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, ``text`` and ``n_chars`` (its code points).

    Whole pages are read; a null page counts as empty. Ids and urls, nulls included, pass
    through; repeated rows stay. Other columns of ``pages`` are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    found = rows.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
