"""Operator 7: main text of web pages by text-to-tag ratios.

Parser events of the standard library stream into lines: a line is the text between two block
borders, with the number of tags that it took, the characters inside links, and the containers it
stands in. Lines in containers that never hold an article (navigation, asides, scripts, forms, hidden ones,
and those whose role, class or id names a menu, advert, notice, comments and the like) are left out;
a form, a hidden part or such a name does not count around the page's only article or on most of the page's text, and a name like
``related`` or ``share`` inside an article neither on a paragraph nor on a longer part that is not mostly links.
Of the rest the text-to-tag ratios are smoothed with a Gaussian along the page; lines above the
threshold, one deviation, are the content cluster. The region is the smallest container that holds
every line of the cluster, or the article or main element around it, and all its lines that are not
left out are the text, short ones included. Where a heading stands next to the region, it and the
lines from it on in its container that are not mostly links belong to the text as well.

Null and empty html and pages without text give the empty text. Broken markup is read as the
parser reads it: unclosed elements end with their parent. Repeated rows give one result each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortspark.llm.common import ship, strings, tidy

# Fixed values of the HTML standard: elements by the part they play in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "applet aside audio button canvas datalist dialog footer frameset head iframe map menu nav noframes noscript object script "
    "select style svg template textarea title video".split()
)
CONTAINERS = frozenset("article body div main section td".split())
# Words of a role, class or id that say a container is no article.
SAYS = re.compile(
    r"(?:^|[\s_-])(ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|"
    r"complementary|contentinfo|cookie|cookies|consent|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"notification|popup|promo|promoted|promotion|related|replies|respond|search|share|sharing|sidebar|signup|skip|skyscraper|social|"
    r"sponsor|sponsored|subscribe|subscription|teaser|toolbar|widget|widgets)(?:$|[\s_-])",
    re.IGNORECASE,
)
# Parts that make such a word a remark on the page around it.
MODIFIES = re.compile(r"(?:^|[_-])(?:has|with|without|no)[_-]|[_-](?:open|opened|closed)$", re.IGNORECASE)
SIDE = re.compile(r"[_-](?:left|right)$", re.IGNORECASE)
# Words that a part of an article's own text may have for a name as well.
OWN_WORDS = frozenset("menu promotion related respond search share sharing skip social teaser widget widgets".split())
TEXT_BLOCKS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
LONG = 200  # characters outside links from which a part of an article with such a name is text
TALK = frozenset("comment comments commentlist disqus replies respond".split())
FENCES = frozenset("ul ol table blockquote form nav aside".split())
HIDDEN = re.compile(r"display\s*:\s*none")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_HEADERS = frozenset(["header", "hgroup"])
SIGMA = 1.0  # lines of smoothing


@lru_cache(maxsize=4096)
def says(value: str) -> str:
    """The word by which a role, class or id names a container that is no article, or the empty text.

    A word behind has, with or no, or before open, speaks of the page around; so does one with a side beside other names.
    """
    names = value.split()
    for name in names:
        found = SAYS.search(name)
        if found and not MODIFIES.search(name) and not (len(names) > 1 and SIDE.search(name)):
            return found[1].lower()
    return ""


class Line(NamedTuple):
    parts: list[tuple[str, bool, int]]  # text, in a link, innermost doubt or 0
    tags: int
    container: int  # innermost open container
    level: int  # of a heading, or 0


class Lines(HTMLParser):
    """Collects ``lines``; containers, articles and doubts are numbered as they open and know their parents.

    Doubts are elements whose name, or the fact that they are hidden or a form, says that they are no article; ``kept_lines`` settles
    them. Every look at what is open goes by the place of its last one, so the time is linear in the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # tag, container, left out, doubted, article or main
        self.places: dict[str, list[int]] = {}  # of open elements, by tag
        self.blocks: list[int] = []
        self.walls: list[int] = []  # that an end tag of something inside does not reach beyond
        self.fences: list[int] = []  # that a start tag does not end anything beyond
        self.kinds, self.parent, self.end, self.path = [""], [0], [0], [0]  # of containers; the last: those open
        self.article, self.article_parent, self.article_doubt = [0], [0], [0]  # container, and innermost article and doubt around
        self.articles = [0]  # those open
        self.doubts, self.doubt_parent = [(False, False, False)], [0]  # of comments, inside an article, a word of its own
        self.doubted = [0]  # those open
        self.text_of: dict[tuple[int, int], int] = {}  # characters outside links by innermost article and doubt
        self.out = self.links = self.tags = 0
        self.parts: list[tuple[str, bool, int]] = []

    def border(self) -> None:
        if self.parts:
            if any(not text.isspace() for text, _, _ in self.parts):
                block = self.open[self.blocks[-1]][0] if self.blocks else ""
                self.lines.append(Line(self.parts, self.tags, self.path[-1], int(block[1]) if block in HEADINGS else 0))
                self.tags = 0
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.border()
            elif tag == "br" and not self.out:
                self.parts.append((" ", False, self.doubted[-1]))
            return
        if tag in BLOCKS:
            self.border()
            if tag == "p" or tag == "li" or tag[0] == "h" and tag[1:].isdigit():
                self.close_open(tag)
        inside = len(self.articles) > 1
        gone = tag in LEFT_OUT or tag in PAGE_HEADERS and not inside
        word = "form" if tag == "form" else ""
        if not gone and attrs and tag not in ("html", "body"):
            if any(k == "hidden" or v and (k == "aria-hidden" and v == "true" or k == "style" and HIDDEN.search(v)) for k, v in attrs):
                word = "hidden"
            elif tag not in ("article", "main"):
                word = next((w for k, v in attrs if v and k in ("class", "id", "role") and (w := says(v))), word)
                if word in OWN_WORDS and tag in TEXT_BLOCKS:
                    word = ""
        at = len(self.open)
        if word:
            self.doubt_parent.append(self.doubted[-1])
            self.doubted.append(len(self.doubts))
            self.doubts.append((word in TALK, inside, word in OWN_WORDS))
        whole = tag in ("article", "main")
        if tag in CONTAINERS:
            self.parent.append(self.path[-1])
            self.path.append(len(self.kinds))
            self.kinds.append(tag)
            self.end.append(0)
            if whole:
                self.article_parent.append(self.articles[-1])
                self.articles.append(len(self.article))
                self.article.append(self.path[-1])
                self.article_doubt.append(self.doubted[-1])
        self.out += gone
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if whole or tag in ("body", "table"):
            self.walls.append(at)
        if tag in CONTAINERS or tag in FENCES or gone or word:
            self.fences.append(at)
        self.open.append((tag, tag in CONTAINERS, gone, bool(word), whole))

    def close_open(self, tag: str) -> None:
        """A new ``tag`` ends one that is still open in the same container, as the standard says."""
        own = self.places.get(tag)
        if own and (not self.fences or own[-1] >= self.fences[-1]):
            self.end_from(own[-1])

    def end_from(self, at: int) -> None:
        while len(self.open) > at:
            tag, container, gone, doubted, whole = self.open.pop()
            self.places[tag].pop()
            for stack in (self.blocks, self.walls, self.fences):
                if stack and stack[-1] == len(self.open):
                    stack.pop()
            if container:
                self.end[self.path.pop()] = len(self.kinds) - 1
            if whole:
                self.articles.pop()
            if doubted:
                self.doubted.pop()
            self.out -= gone
            self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.border()
        own = self.places.get(tag)
        if own and (not self.walls or own[-1] >= self.walls[-1] or tag in CONTAINERS or tag in LEFT_OUT or tag in ("html", "form")):
            self.end_from(own[-1])

    def handle_data(self, data: str) -> None:
        if not self.out:
            linked, doubt = self.links > 0, self.doubted[-1]
            self.parts.append((data, linked, doubt))
            if not linked:
                key = (self.articles[-1], doubt)
                self.text_of[key] = self.text_of.get(key, 0) + len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass

    def finish(self) -> None:
        self.border()
        self.end_from(0)
        self.end[0] = len(self.kinds) - 1


def up(values: list[int], parent: list[int]) -> list[int]:
    """Sums over each number and all below it."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def lifted(parser: Lines) -> list[bool]:
    """Whether a doubt does not hold: around the page's article, with most of its text outside links, or the article's own text by a name.

    Where an article or main element has text of its own outside all doubts, only doubts inside one can be lifted by
    their share; comments only where there is nothing else.
    """
    held, linked = [0] * len(parser.doubts), [0] * len(parser.doubts)
    for (_, doubt), n in parser.text_of.items():
        held[doubt] += n
    for line in parser.lines:
        for text, link, doubt in line.parts:
            linked[doubt] += len(text.strip()) if link else 0
    held, linked = up(held, parser.doubt_parent), up(linked, parser.doubt_parent)
    total = held[0]
    talks = [False] * len(parser.doubts)  # whether a doubt or one around it is of comments
    depth = [0] * len(parser.doubts)
    for d in range(1, len(parser.doubts)):
        talks[d] = parser.doubts[d][0] or talks[parser.doubt_parent[d]]
        depth[d] = depth[parser.doubt_parent[d]] + 1
    own = [0] * len(parser.article)
    for (article, doubt), n in parser.text_of.items():
        if article and parser.article_doubt[article] == doubt:
            own[article] += n
    for a in range(len(own) - 1, 0, -1):  # an article's text is also that of the one around it, under the same doubts
        if (around := parser.article_parent[a]) and parser.article_doubt[around] == parser.article_doubt[a]:
            own[around] += own[a]
    real = [a for a in range(1, len(own)) if own[a] and not (talks[parser.article_doubt[a]] and 2 * own[a] <= total)]  # others are comments
    best = min(real, key=lambda a: (depth[parser.article_doubt[a]], -own[a]), default=None)
    out = [False] * len(parser.doubts)
    if best is not None:
        d = parser.article_doubt[best]
        while d:
            out[d] = True
            d = parser.doubt_parent[d]
    for d in range(1, len(out)):
        talk, inside, word = parser.doubts[d]
        if 2 * held[d] > total and (best is None or inside) and (not talk or held[d] == total):
            out[d] = True
        if word and inside and held[d] >= LONG and 4 * linked[d] < held[d]:
            out[d] = True
    return out


def kept_lines(parser: Lines) -> list[tuple[str, int, int, int, int]]:
    """Lines as text, tags, characters inside links, container and heading level, without what doubts that hold cover."""
    free = lifted(parser)
    free[0] = True
    for d in range(1, len(free)):
        free[d] &= free[parser.doubt_parent[d]]
    out = []
    for line in parser.lines:
        parts = [(text, link) for text, link, doubt in line.parts if free[doubt]]
        text = " ".join("".join([t for t, _ in parts]).split())
        if text:
            out.append((text, line.tags, sum(len(t) for t, link in parts if link), line.container, line.level))
    return out


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the window is cut off at the ends of the page."""
    reach = math.ceil(2 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        own = weights[lo - i + reach : hi - i + reach]
        out.append(sum(v * w for v, w in zip(values[lo:hi], own, strict=True)) / sum(own))
    return out


UNENDED = re.compile(r"<[a-zA-Z/!?]")


def parsed(html: str) -> Lines:
    """The lines of a page. Behind the last tag's end nothing but text is read, so that no unended tag is tried again and again."""
    parser = Lines()
    last = html.rfind(">") + 1
    m = UNENDED.search(html, last)
    parser.feed(html[: m.start()] if m else html)
    parser.close()
    parser.finish()
    return parser


def main_text(html: str) -> str:
    """The article of a page, one block per line."""
    parser = parsed(html)
    lines = kept_lines(parser)
    if not lines:
        return ""
    ratios = smooth([(len(text) - linked) / max(tags, 1) for text, tags, linked, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    cluster = [i for i, ratio in enumerate(ratios) if ratio >= threshold]
    cluster = [i for i in cluster if len(lines[i][0]) > lines[i][2]] or cluster
    # containers are numbered as they open, so the one around the first and the last number is around all
    places = [lines[i][3] for i in cluster]
    region, last = min(places), max(places)
    while parser.end[region] < last:
        region = parser.parent[region]
    around, c = [], region
    while c:
        around.append(c)
        c = parser.parent[c]
    articles = [c for c in around if parser.kinds[c] == "article"]
    mains = [c for c in around if parser.kinds[c] == "main"]
    region = articles[-1] if articles else mains[0] if mains else region
    inside = [region <= line[3] <= parser.end[region] for line in lines]
    start, end, part = beside(parser, lines, inside, region, cluster[0])
    return "\n".join(
        text for i, (text, _, linked, place, level) in enumerate(lines)
        if inside[i] or start <= i < end and part <= place <= parser.end[part] and (i == start or level or 2 * linked < len(text))
    )


def beside(parser: Lines, lines: list, inside: list[bool], region: int, first_of_cluster: int) -> tuple[int, int, int]:
    """Where the text goes on around the region: the first line, the end, and the container of a heading next to it.

    The heading is the last of level 1 before the region in the nearest container around it, or else the last of any level. A
    region with a heading of its own at its beginning, and an article or main element, take only a heading right beside them.
    """
    nothing = (0, 0, 0)
    first = inside.index(True)
    own = {lines[i][4] for i in range(first, first_of_cluster + 1) if inside[i]} - {0}
    if not region or 1 in own or parser.kinds[region] == "body":
        return nothing
    whole = parser.kinds[region] in ("article", "main")
    heads = [i for i in range(first) if lines[i][4]]
    around = parser.parent[region]
    if own or whole:
        heads = [i for i in heads if lines[i][3] == around and (not own or lines[i][4] < min(own))]
    elif heads:
        latest = max(lines[i][3] for i in heads)  # a heading in front of the region is in a container around it that opened before
        while latest < around:
            around = parser.parent[around]
        heads = [i for i in heads if around <= lines[i][3] <= parser.end[around]]
    if not heads:
        return nothing
    top = [i for i in heads if lines[i][4] == 1]
    start = (top or heads)[-1]
    page = not around or parser.kinds[around] == "body"
    on = not whole and (not page or lines[start][3] == around)
    return start, len(lines) if on else first, around


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of ``pages``: the ``keep`` columns, ``text`` and ``n_chars``, its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in strings(batch, "_html")]
            arrays = [batch.column(f"_{i}") for i in range(len(keep))]
            arrays += [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])

    ship(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    rows = pages.select(*[pages[c].alias(f"_{i}") for i, c in enumerate(keep)], pages[html_col].alias("_html"))
    return rows.mapInArrow(tidy(run), f"{kinds}, text string, n_chars bigint")
