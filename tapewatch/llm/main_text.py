"""The main text of a web page by composite text density.

A page is read into a tree. Parts that name themselves as something else (by tag, role or a word of their class or id) are
left out. For every node that remains the composite text density is taken: characters per tag, adjusted by the share of
characters and tags that belong to links. The densities of a node's children are summed, and the node with the largest sum
holds the main text. The smallest density on the path from it up to the body is the threshold for other parts: a
headline or a further block beside it belongs to the text if it reaches the threshold, a list of links does not. Where the page marks an
article, only nodes within articles compete, and the whole of the winning article is the text.

Character references are decoded once. Inside a block white space (as Unicode has it) is one space, a line break and the border
between table cells are white space; blocks are trimmed, empty ones left out, the others joined by a newline in page order.

Defined cases: a null or empty page has the empty text; so has a page of other parts only; text outside any tag is a block; tags left
open, closed twice or cut off at the end are mended as browsers do in the common cases, a tag that never ends is left out; repeated
rows are read one by one; a column named like the output is replaced; an empty table stays empty; a page of any length and depth
is read whole, in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.runtime import text_of

#: Elements of the page language by what they do.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Open elements that a start tag ends, and those at which the search for them stops.
ENDS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("tr",), (("tr",), ("table",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
    **dict.fromkeys(("option", "optgroup"), (("option",), ("select",))),
}
ENDS_PARAGRAPH = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody tfoot thead tr".split())
#: Elements that an end tag of an inline element does not reach beyond, and that bound the search for an open paragraph.
SCOPE = frozenset("td th caption table html body template button object".split())

#: Elements, roles and words of classes and ids of what is not the main text.
LEFT_OUT = frozenset("head script style title noscript template nav footer aside button select textarea iframe object embed svg canvas audio video map dialog menu search noembed noframes".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars sidenav footer footers header masthead topbar banner banners comment comments commentlist disqus respond replies cookie cookies consent gdpr notice "
    "notices alert popup modal newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations recirculation widget "
    "widgets pagination pager toolbar copyright taboola outbrain paywall".split()
)
#: Words that tell nothing where the name also has a word of the text itself, as in "entry-header".
WEAK_WORDS = frozenset("header banner promo promotion notice alert widget related social".split())
TEXT_WORDS = frozenset("article content entry post story main body text".split())
#: Words of parts that are something else even where they hold articles of their own.
ASIDE_WORDS = frozenset("comment comments commentlist disqus respond replies related recommended recommendations recirculation ad ads advert advertisement sponsored".split())
#: How a part is left out: not at all, unless the page's article stands in it, in any case.
TEXT, FRAME, OTHER = range(3)
#: A class such as "has-sidebar" tells what stands beside the element.
BESIDE = re.compile(r"(?:has|with|no|without|hide|show)[-_]")

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)"""
    r"""|(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?P<closed>>)?)""",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)


def attributes_of(raw: str) -> dict[str, str]:
    """The attributes that say what a part is; the first of a name holds."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), double or single or bare)
    return found


def named_as(attributes: dict[str, str], article: bool) -> int:
    """What role, class and id say about a part; an article is only told from comments and the like."""
    if "hidden" in attributes or _INVISIBLE.search(attributes.get("style", "")) or attributes.get("itemprop") == "comment":
        return OTHER
    if not LEFT_OUT_ROLES.isdisjoint(attributes.get("role", "").lower().split()):
        return FRAME
    found = TEXT
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        if BESIDE.match(name.lower()):
            continue
        words = {w.lower() for w in _WORD.findall(name)}
        other = words & LEFT_OUT_WORDS
        if article:
            other = other & ASIDE_WORDS if name.lower().split("-")[0].split("_")[0] in ASIDE_WORDS else ()
        if other and not (other <= WEAK_WORDS and words & TEXT_WORDS):
            found = max(found, FRAME if ASIDE_WORDS.isdisjoint(other) else OTHER)
    return found


class Page:
    """A page's elements in page order, each with the place of its parent, and its pieces of text.

    ``pieces`` holds ``(element, text)``; a text of None is the border of a block.
    """

    def __init__(self, html: str):
        self.tags: list[str] = ["html"]
        self.parents: list[int] = [0]
        self.left_out: list[int] = [TEXT]
        self.roles: list[str] = [""]
        self.pieces: list[tuple[int, str | None]] = []
        self.open: list[int] = [0]
        self.opened = Counter(html=1)
        self.read(html)

    def read(self, html: str) -> None:
        at, size, find = 0, len(html), _TAG.search
        while at < size:
            tag = find(html, at)
            if tag is None:
                self.text(html[at:])
                return
            if tag.start() > at:
                self.text(html[at : tag.start()])
            at = tag.end()
            if tag["end"]:
                self.end(tag["end"].lower())
            elif tag["start"] and tag["closed"]:
                name = tag["start"].lower()
                self.start(name, tag["attributes"])
                if name in RAW:
                    stop = _RAW_END[name].search(html, at)
                    at = stop.start() if stop else size

    def text(self, text: str) -> None:
        here = self.open[-1]
        if self.tags[here] == "head" and not text.isspace():
            self.ended(len(self.open) - 1)
            here = self.open[-1]
        self.pieces.append((here, text))

    def start(self, name: str, raw: str) -> None:
        tags, opened = self.tags, self.open
        if tags[opened[-1]] == "head" and name not in HEAD_ONLY:
            self.ended(len(opened) - 1)
        if name in ("html", "body") and (name == "html" or len(opened) > 1):
            return
        if name in ENDS_PARAGRAPH:
            self.close(("p",), SCOPE)
            if name in HEADINGS and tags[opened[-1]] in HEADINGS:
                self.ended(len(opened) - 1)
        elif name in ENDS:
            self.close(*ENDS[name])
        if name == "br" or name in CELLS:
            self.pieces.append((opened[-1], " "))
        elif name in BLOCK:
            self.pieces.append((opened[-1], None))
        if name in VOID:
            return
        attributes = attributes_of(raw) if raw else {}
        parent = opened[-1]
        role = attributes.get("itemprop") or attributes.get("role") or ""
        role = "article" if name == "article" or role == "articleBody" else "main" if name == "main" or role == "main" else ""
        self.roles.append(role)
        kind = OTHER if name in LEFT_OUT else FRAME if name == "form" else TEXT
        if attributes and not kind and name != "body":
            kind = named_as(attributes, bool(role))
        self.left_out.append(kind)
        self.opened[name] += 1
        opened.append(len(tags))
        tags.append(name)
        self.parents.append(parent)

    def close(self, names: tuple[str, ...], stop: tuple[str, ...] | frozenset) -> None:
        """End the nearest open element of ``names`` and all in it, if none of ``stop`` is nearer."""
        if not any(self.opened[name] for name in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[k]]
            if tag in names:
                self.ended(k)
                return
            if tag in stop:
                return

    def ended(self, k: int) -> None:
        if any(self.tags[n] in BLOCK for n in self.open[k:]):
            self.pieces.append((self.open[k - 1], None))
        self.opened.subtract(self.tags[n] for n in self.open[k:])
        del self.open[k:]

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name in ("p", "br") or name in HEADINGS:
            # an end tag of any heading ends the open one
            self.close(tuple(HEADINGS) if name in HEADINGS else (name,), SCOPE)
        elif name in BLOCK or name in SCOPE or name == "head":
            self.close((name,), ("html",) if name in ("table", "head") else ("table", "td", "th") if name not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else ("table",))
        else:
            # an inline element does not end the block it stands in
            self.close((name,), BLOCK | CELLS)


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Composite text density: characters per tag, less the more of both are links."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    link_chars, link_tags, others = max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = log(chars / others * link_chars + body_share * chars + e)
    return max(0.0, chars / tags * log(chars / link_chars * tags / link_tags) / log(base))


def kept_nodes(page: Page) -> list[bool]:
    """Whether each element and all around it are possible text."""
    tags, parents, kind = page.tags, page.parents, page.left_out
    size = len(tags)
    # what holds an article is the frame of the page, whatever its name; a form may also be the frame around a headline
    holds, titled = [False] * size, [False] * size
    for k in range(size - 1, 0, -1):
        p = parents[k]
        if kind[k] != OTHER:
            holds[p] |= holds[k] or bool(page.roles[k])
            titled[p] |= titled[k] or tags[k] == "h1"
    kept, within, headline = [True] * size, [False] * size, [True] * size
    for k in range(1, size):
        p = parents[k]
        within[k] = within[p] or bool(page.roles[k])
        frame = holds[k] or (tags[k] == "form" and titled[k])
        kept[k] = kept[p] and (kind[k] == TEXT or (kind[k] == FRAME and frame))
        if tags[k] == "header" and not holds[k]:
            # of headers only the headings of an article's own one are text
            kept[k] = kept[k] and within[k]
            headline[k] = False
        else:
            headline[k] = headline[p] or tags[k] in HEADINGS
    return [x and y for x, y in zip(kept, headline)]


def chosen_nodes(page: Page, kept: list[bool]) -> list[bool]:
    """The elements whose own text is main text."""
    tags, parents, size = page.tags, page.parents, len(page.tags)
    in_link = [False] * size
    for k in range(1, size):
        in_link[k] = in_link[parents[k]] or tags[k] == "a"
    # inline elements without blocks belong to the block they stand in: with its own text they are its line
    unit = [tag in BLOCK or tag in CELLS for tag in tags]
    for k in range(size - 1, 0, -1):
        if unit[k]:
            unit[parents[k]] = True
    owner = list(range(size))
    for k in range(1, size):
        if not unit[k]:
            owner[k] = owner[parents[k]]
    line = [[0, 0, 0, 0] for _ in range(size)]
    for k in range(size):
        if kept[k]:
            line[owner[k]][1] += 1
            line[owner[k]][3] += in_link[k]
    for k, text in page.pieces:
        if text is not None and kept[k] and not text.isspace():
            line[owner[k]][0] += len(text)
            line[owner[k]][2] += len(text) * in_link[k]
    total = [own[:] for own in line]
    for k in range(size - 1, 0, -1):
        if unit[k]:
            up = total[owner[parents[k]]]
            for place, value in enumerate(total[k]):
                up[place] += value
    share = total[0][2] / max(total[0][0], 1)
    chars = [t[0] for t in total]
    direct = [own[0] for own in line]
    own = [density(*t, share) for t in total]
    # the line of a block counts as one more child
    sums = [density(*own_line, share) for own_line in line]
    for k in range(1, size):
        if unit[k]:
            sums[owner[parents[k]]] += own[k]

    articles = [k for k in range(1, size) if page.roles[k] == "article" and kept[k] and chars[k]]
    inside = [False] * size
    for k in range(1, size):
        inside[k] = inside[parents[k]] or page.roles[k] == "article"
    outer = [k for k in articles if not inside[parents[k]]]
    if outer:
        best = max(outer, key=lambda k: (sums[k], -k))
        found = below(parents, {best})
        if len(outer) == 1 and not any(tags[k] == "h1" and found[k] and kept[k] for k in range(size)):
            # the headline may stand before the article
            return below(parents, {best, *(k for k in range(best) if tags[k] == "h1")})
        return found
    mains = [k for k in range(1, size) if page.roles[k] == "main" and kept[k] and chars[k]]
    region = below(parents, {max(mains, key=lambda k: (chars[k], -k))} if mains else {0})
    inner = [k for k in range(size) if region[k] and kept[k] and chars[k]]
    if not inner:
        return [False] * size
    best = max(inner, key=lambda k: (sums[k], -k))
    path, k = [best], best
    while k:
        k = parents[k]
        path.append(k)
    threshold = min(own[k] for k in path)
    # of each subtree the element with the largest sum, the outer one of equal ones
    top = list(range(size))
    for k in range(size - 1, 0, -1):
        p = parents[k]
        if sums[top[k]] > sums[top[p]]:
            top[p] = top[k]
    marked = {best} | {top[k] for k in inner if own[k] >= threshold}
    # text standing in an element on the path itself is as near to the main text
    found = below(parents, marked)
    return [f or (region[k] and direct[k] > 0 and k in path) for k, f in enumerate(found)]


def below(parents: list[int], roots: set[int]) -> list[bool]:
    """Whether each element is one of ``roots`` or within one."""
    found = [0 in roots]
    for k in range(1, len(parents)):
        found.append(found[parents[k]] or k in roots)
    return found


def main_text(html: str) -> str:
    """The main text of one page."""
    page = Page(html)
    kept = kept_nodes(page)
    chosen = chosen_nodes(page, kept)
    blocks, now = [], []
    for k, text in [*page.pieces, (0, None)]:
        if text is None:
            if now:
                blocks.append(" ".join(unescape("".join(now)).split()))
                now = []
        elif kept[k] and chosen[k]:
            now.append(text)
    return "\n".join(filter(None, blocks))


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` as ``out``."""

    @F.pandas_udf("string")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([main_text(t) for t in batch], dtype=object)

    return pages.withColumn(out, extract(text_of(html)))
