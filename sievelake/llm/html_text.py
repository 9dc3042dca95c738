"""Main text of web pages by block rules in two passes.

The page is read as a stream of tags and texts into blocks (runs of text without a block tag in
between). The first pass decides what a block says about itself: places that pages keep for
other things (menus, footers, adverts, forms, comments), its link density, and, outside an
article element, its length and stop-word density. Short blocks and others without a clear sign
stay open; the second pass gives them the label of their nearest decided neighbours.

Class names and ids that have a sign as one of several words ("comments-area", "sidebar-right") often
tell the layout or topic of what an article element is in, so they say nothing about an article
element below them, unless the page has text in another one outside; nor does a form around one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.quality_rules import STOP_WORDS

STOPS = frozenset(STOP_WORDS)
#: Elements whose content is not text, up to their end tag or the end of the page.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes annotation annotation-xml".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img map nobr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot "
                   "mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
#: Elements that hold no article text wherever they stand.
ASIDE = frozenset("nav aside footer form head button select option datalist dialog menu template svg object audio video canvas "
                  "fieldset figcaption".split()) - {"figcaption"}
MAIN = frozenset(("article", "main"))
#: Elements that are parts of a text rather than holders of several.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr tbody thead table pre blockquote figure figcaption center".split())
#: Parts of class names and ids of places that hold no article text, and of page heads.
SIGNS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner "
                  "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup nav navbar "
                  "navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars aside rail footer foot comment comments "
                  "commentlist respond reply replies disqus discussion share sharing social related recommended widget widgets popup "
                  "modal overlay login register search searchform pagination pager toolbar skip teaser teasers outbrain taboola "
                  "copyright legal disclaimer tags form feedback".split())
HEADS = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
LAYOUT = frozenset("with has no without".split())
#: Names of topics and states that sites give to an article and to what it is in.
TOPIC = re.compile(r"(?:category|tag)-|.*-(?:open|closed)$")

START = re.compile(r"<(?:(?P<note>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)|[!?/])")
NOTE_END = re.compile(r"(?<=<!--)-?>|--!?>")
#: Attributes up to the end of their tag; a quote without another one after it bounds nothing.
ATTRS = re.compile(r"(?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>")
ATTR = re.compile(r"([^\s\"'=<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    aside: bool
    inside: int  # number of the article or main element around it, 0 for none
    heading: bool
    holder: int  # number of the element around it that is not itself a part of a text
    under: bool = False  # whether a name with a sign among its words stands above the article element around it


@dataclass(frozen=True)
class Limits:
    """Thresholds outside article elements: words and shares."""

    links: float = 0.5
    short_words: int = 10
    long_words: int = 20
    stops_low: float = 0.1
    stops_high: float = 0.25
    heading_reach: int = 3


def _signs(attrs: str, element: str = "") -> tuple[bool, bool, bool, bool, bool]:
    """Whether the attributes name a place without article text, or a head; then the same of
    names that have the sign as one of several words; then whether such a name tells no topic or state."""
    aside = head = part = head_part = telling = False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("hidden",) or name == "aria-hidden" and value.lower() == "true":
            aside = True
        elif name == "style":
            aside |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            head |= value.lower() == "banner"
            aside |= value.lower() in ROLES - {"banner"} and not value.lower() == element == "form"
        elif name in ("class", "id"):
            for one in value.split():
                words = set(NAMES.findall(CAMEL.sub(" ", one).lower())) - ({element} if element == "form" else set())
                if not words & LAYOUT:
                    if one.lower() in words:
                        aside |= bool(words & SIGNS)
                        head |= bool(words & HEADS)
                    elif words & (SIGNS | HEADS):
                        part |= bool(words & SIGNS)
                        head_part |= bool(words & HEADS)
                        telling |= not TOPIC.match(one.lower())
    return aside, head, part, head_part, telling


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of the tags of a page, comments and the like
    with an empty name, in time linear in the page.

    What is unfinished when the page ends goes on to its end, but where only quotes hide all later tag ends, quotes
    bound nothing from there on. An element whose content is not text is one piece without a name.
    """
    at, quotes = 0, True
    while m := START.search(page, at):
        start, at = m.span()
        name, ends, attrs = (m["name"] or "").lower(), bool(m["end"]), ""
        if m["note"]:
            stop = NOTE_END.search(page, at)
            at = stop.end() if stop else len(page)
        else:
            whole = ATTRS.match(page, at) if name and quotes else None
            quotes &= not name or bool(whole)
            stop = whole.end() if whole else page.find(">", at) + 1
            attrs, at = page[at:stop - 1], stop or len(page)
            if not stop:
                name = ""
        if name in RAW and not ends:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            name, at = "", stop.end() if stop else len(page)
        yield start, at, name, ends, attrs


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with text, in its order."""
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    # Open elements other than inline ones: (name, no article text from here on, none but in an article element,
    # whether a telling name is among the reasons, whether one stands above the article, its number, whether it is
    # an article rather than a main element, holder's number).
    top = ("", False, False, False, False, 0, False, 0)
    open_tags: list[tuple[str, bool, bool, bool, bool, int, bool, int]] = []
    open_names: Counter[str] = Counter()
    links = articles = holders = 0
    heading = False

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len("".join(piece.split()))

    def close() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, aside, weak, _, under, inside, _, holder = open_tags[-1] if open_tags else top
                found.append(Block(text, linked, aside or weak, inside, heading, holder, under))
            parts, linked = [], 0

    at = 0
    for start, stop, name, ends, attrs in _tags(page):
        put(page[at:start])
        at = stop
        if not name:
            continue
        if ends:
            if name == "a":
                links = 0
            if name in INLINE:
                continue
            close()
            if name[0] == "h" and name[1:].isdigit():
                heading = False
            if open_names[name]:
                while True:
                    gone = open_tags.pop()[0]
                    open_names[gone] -= 1
                    if gone == name:
                        break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links = 1
        if name in INLINE:
            continue
        close()
        links = 0 if name not in VOID else links
        if name in VOID:
            continue
        heading = name[0] == "h" and name[1:].isdigit()
        if name == "p" and open_tags and open_tags[-1][0] == "p":  # one paragraph ends another
            open_tags.pop()
            open_names["p"] -= 1
        _, aside, weak, told, under, inside, single, holder = open_tags[-1] if open_tags else top
        own, head, part, head_part, telling = _signs(attrs, name) if attrs and name not in ("html", "body") else (False,) * 5
        aside |= own or name in ASIDE - {"form"} or (head or name == "header") and not inside
        if name in MAIN:
            if not aside:
                articles += 1
                inside, single = articles, single or name == "article"
                under, weak, told = under or told, False, False
        else:
            part |= head_part and not inside
            if single:  # in an article, what is set off so stays out with all it holds
                aside |= part or name == "form"
            else:
                weak |= part or name == "form"
                told |= part and telling
        if name not in PARTS:
            holders += 1
            holder = holders
        if not attrs.endswith("/") or name != "svg":
            open_tags.append((name, aside, weak, told, under, inside, single, holder))
            open_names[name] += 1
    put(page[at:])
    close()
    return found


def _mostly_links(b: Block, limits: Limits) -> bool:
    return b.linked > limits.links * len("".join(b.text.split()))


def _first_pass(b: Block, in_article: bool, limits: Limits) -> bool | None:
    """True: text of the article, False: not, None: open."""
    if b.aside or in_article and not b.inside:
        return False
    if _mostly_links(b, limits):
        return None if b.inside else False
    words = [re.sub(r"[\W\d_]+", "", w).lower() for w in b.text.split()]
    stops = sum(w in STOPS for w in words) / len(words)
    if b.heading or len(words) < limits.short_words:
        return None
    if stops >= limits.stops_high or len(words) >= limits.long_words and stops >= limits.stops_low:
        return True
    # A long text without function words may be a list or a bad text of the article.
    return None if b.inside or stops >= limits.stops_low else False


def labels(blocks: list[Block], limits: Limits = Limits()) -> list[bool]:
    """Whether each block belongs to the main text.

    An open block takes the label of its decided neighbours when both agree, and when they do
    not that of the nearer one (the one after it for a heading or a tie). Neighbours are looked for
    in the element around the block, and if it has none, in the same article element or outside
    all of them; without any, blocks of an article element stay and others go. A block of links
    that is no heading stays in an article element only between blocks of it that stay.
    """
    in_article = any(b.inside and not b.aside for b in blocks)
    first = [_first_pass(b, in_article, limits) for b in blocks]
    if any(x and b.inside and not b.under for x, b in zip(first, blocks)):
        first = [False if b.under else x for x, b in zip(first, blocks)]
    out = list(first)
    n = len(blocks)

    def neighbours(group) -> tuple[list[int], list[int]]:
        before, after = [-1] * n, [-1] * n
        for steps, memo in ((range(n), before), (range(n - 1, -1, -1), after)):
            last: dict[int, int] = {}
            for i in steps:
                memo[i] = last.get(group(blocks[i]), -1)
                # Inside an article, what is set off there (an advert, a form) says nothing about the text around it.
                if first[i] is not None and not (blocks[i].inside and first[i] is False):
                    last[group(blocks[i])] = i
        return before, after

    close, wide = neighbours(lambda b: b.holder), neighbours(lambda b: b.inside)
    for i, b in enumerate(blocks):
        if first[i] is None:
            a, z = close[0][i], close[1][i]
            if a < 0 and z < 0:
                a, z = wide[0][i], wide[1][i]
            if a < 0 and z < 0:
                out[i] = bool(b.inside)
            elif a < 0 or z < 0:
                out[i] = first[max(a, z)]
            elif first[a] == first[z]:
                out[i] = first[a]
            elif b.heading and z - i <= limits.heading_reach:
                out[i] = first[z]
            else:
                out[i] = first[z] if z - i <= i - a else first[a]
    links = [bool(b.inside) and first[i] is None and not b.heading and _mostly_links(b, limits) for i, b in enumerate(blocks)]
    span: dict[int, tuple[int, int]] = {}  # first and last block of an article that stay by themselves
    for i, b in enumerate(blocks):
        if b.inside and out[i] and not links[i]:
            span[b.inside] = (span.get(b.inside, (i, i))[0], i)
    for i, b in enumerate(blocks):
        if links[i]:
            begin, end = span.get(b.inside, (i, i))
            out[i] = begin < i < end
    return [bool(x) for x in out]


def main_text(page: str | None, limits: Limits = Limits()) -> str:
    """The blocks of the main text joined by two line ends; empty for a null or empty page."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, kept in zip(blocks, labels(blocks, limits)) if kept)


def extracted(pages: DataFrame, page: str = "html", out: str = "text", limits: Limits = Limits()) -> DataFrame:
    """`pages` with the main text of the whole page as column `out` (never null).

    A null or empty page and one without main text give an empty text. A column named `out` is
    replaced; all others, and repeated rows, come through.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: main_text(p, limits), na_action=None)

    return pages.withColumn(out, extract(F.coalesce(F.col(f"`{page}`").cast("string"), F.lit(""))))
