"""Main text of web pages: flat text blocks judged by a small decision tree.

A page is cut into blocks at block-level tags. For each block the tree sees its
number of words and its link density, those of the blocks before and after it,
whether it is a heading, whether it lies in the page's article, and in how many
boilerplate regions (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments) it is nested. The tree is grown from the labelled table below.

Class and id names mark regions too, but a wrapper around the whole page may carry
such a name. Names of a state ('has-sidebar', 'nav-open') mark none. Where no text of
an article, main or content element is outside regions, the names around those
elements that lie in the fewest named ones count for nothing.

Character references are decoded per text node, white space inside a block
becomes one space, blocks are trimmed and joined in page order by one space.

Defined results
---------------
* Null or empty html, and pages without any content block, have the empty text.
* Scripts, styles, head, comments and other markup are no text. A tag that the
  page breaks off in is dropped; end tags without a start are ignored. A head
  without an end tag ends at the first text or element that cannot be in one.
* Pages of any length are read whole, one at a time. Repeated rows give repeated
  results; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import free_names
from .words import slices

# Element names by the role that HTML gives them.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select button "
                   "textarea title datalist".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
                   "q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset("nav header footer aside form dialog menu".split())
REGION_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# Words of class and id names that mark such regions.
REGION_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot adunit adbanner banner alert announcement sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side rail aside comment comments discussion disqus feedback reply "
    "replies respond cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin share sharing "
    "social related recommended recommendations footer header masthead toolbar widget widgets login search "
    "disclaimer copyright legal pagination pager teaser".split())
# With one of these words before it, such a name tells how a page is laid out.
STATES_BEFORE = frozenset("has no with without".split())
# Words that may stand behind the word of such a region in a name: where it is, or what it holds.
PARTS = frozenset(
    "left right top bottom primary secondary inner outer box bar block blocks list lists container wrapper wrap section "
    "area panel pane slot unit link links item items content contents text title button buttons icon icons form field "
    "image images post posts article articles story stories news page pages column col row group body".split())
# Words that mark the element with the main text on pages without an article or main element.
CONTENT_WORDS = frozenset("content article post entry story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # A quote opens a value only directly after an equals sign.
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>"
    r"|<[!?][^>]*+>"
    r"|<[a-zA-Z/!?][^>]*+\Z", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
                    re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

COLUMNS = ["regions", "article", "heading", "words", "links", "before_words", "before_links", "after_words",
           "after_links"]
# Labelled blocks: the columns above, then 1 for main text. ``article`` is 1 inside the page's
# article, 0 on pages without one, -1 outside it; ``links`` are link densities.
LABELLED = [
    # blocks nested in menus, headers, footers, sidebars, adverts, forms, comments
    (1, -1, 0, 5, 1.0, 0, 0.0, 6, 1.0, 0), (1, -1, 0, 6, 1.0, 5, 1.0, 4, 1.0, 0), (1, -1, 0, 8, 0.0, 6, 1.0, 9, 0.0, 0),
    (1, 1, 0, 40, 0.0, 60, 0.0, 50, 0.0, 0), (1, 1, 0, 3, 0.0, 80, 0.0, 0, 0.0, 0), (2, 1, 0, 25, 0.1, 30, 0.0, 2, 1.0, 0),
    (1, 0, 0, 30, 0.0, 45, 0.0, 12, 0.2, 0), (1, 0, 1, 4, 0.0, 20, 0.0, 50, 0.0, 0), (2, -1, 0, 90, 0.0, 40, 0.0, 0, 0.0, 0),
    (1, 0, 0, 120, 0.0, 60, 0.0, 60, 0.0, 0), (1, 1, 0, 200, 0.0, 90, 0.0, 80, 0.0, 0), (3, 1, 1, 2, 0.0, 1, 0.0, 9, 0.0, 0),
    # inside the article: everything counts, however short, but for lists of links
    (0, 1, 1, 7, 0.0, 12, 0.0, 30, 0.0, 1), (0, 1, 0, 1, 0.0, 30, 0.0, 90, 0.0, 1), (0, 1, 0, 1, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 1, 0, 60, 0.0, 1, 0.0, 120, 0.0, 1), (0, 1, 0, 400, 0.0, 7, 0.0, 9, 0.0, 1), (0, 1, 0, 12, 0.4, 40, 0.0, 8, 0.0, 1),
    (0, 1, 0, 3, 1.0, 50, 0.0, 45, 0.0, 1), (0, 1, 0, 6, 0.8, 20, 0.1, 1, 0.0, 1), (0, 1, 0, 9, 0.0, 3, 1.0, 4, 1.0, 1),
    (0, 1, 0, 2, 0.0, 2, 0.0, 2, 0.0, 1), (0, 1, 1, 3, 0.0, 100, 0.0, 0, 0.0, 1), (0, 1, 0, 25, 0.3, 9, 0.9, 14, 0.2, 1),
    (0, 1, 0, 3, 1.0, 4, 1.0, 3, 1.0, 0), (0, 1, 0, 5, 1.0, 2, 1.0, 6, 1.0, 0), (0, 1, 0, 4, 1.0, 3, 1.0, 5, 1.0, 0),
    (0, 1, 0, 2, 0.0, 30, 0.0, 4, 1.0, 1), (0, 1, 0, 1, 0.0, 4, 1.0, 3, 1.0, 1), (0, 1, 0, 6, 0.0, 0, 0.0, 5, 0.9, 1),
    (0, 1, 0, 5, 0.9, 40, 0.0, 2, 1.0, 1), (0, 1, 0, 5, 0.9, 2, 1.0, 40, 0.0, 1), (0, 1, 1, 2, 0.0, 2, 1.0, 7, 0.5, 1),
    (0, 1, 1, 5, 1.0, 60, 0.0, 40, 0.0, 1), (0, 1, 0, 80, 0.0, 4, 1.0, 3, 1.0, 1), (0, 1, 0, 15, 0.0, 15, 0.0, 15, 0.0, 1),
    (0, 1, 0, 2, 1.0, 1, 0.0, 1, 0.0, 1), (0, 1, 0, 7, 1.0, 0, 0.0, 3, 0.2, 1), (0, 1, 0, 30, 1.0, 5, 0.1, 0, 0.0, 1),
    (0, 1, 0, 12, 1.0, 2, 0.0, 2, 1.0, 1), (0, 1, 0, 2, 1.0, 3, 1.0, 12, 0.0, 1), (0, 1, 0, 300, 1.0, 0, 0.0, 0, 0.0, 1),
    (0, 1, 0, 1, 0.5, 0, 0.0, 10, 1.0, 1), (0, 1, 0, 20, 0.6, 5, 0.0, 3, 1.0, 1), (0, 1, 0, 5, 0.8, 9, 0.0, 4, 1.0, 1),
    (0, 1, 0, 100, 0.7, 3, 0.3, 50, 1.0, 1), (0, 1, 1, 4, 0.6, 30, 0.0, 12, 1.0, 1), (0, 1, 0, 2, 0.8, 2, 1.0, 90, 1.0, 1),
    # outside the article of a page that has one
    (0, -1, 0, 12, 0.0, 5, 1.0, 7, 0.0, 0), (0, -1, 0, 60, 0.0, 50, 0.0, 0, 0.0, 0), (0, -1, 1, 4, 0.0, 0, 0.0, 30, 0.0, 0),
    (0, -1, 0, 2, 1.0, 3, 1.0, 2, 1.0, 0), (0, -1, 0, 150, 0.0, 90, 0.0, 100, 0.0, 0), (0, -1, 0, 1, 0.0, 1, 0.0, 1, 0.0, 0),
    # pages without an article element: length, links and neighbours decide
    (0, 0, 0, 45, 0.0, 60, 0.0, 50, 0.0, 1), (0, 0, 0, 90, 0.05, 8, 0.0, 70, 0.1, 1), (0, 0, 0, 30, 0.2, 2, 1.0, 40, 0.0, 1),
    (0, 0, 0, 20, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 200, 0.0, 3, 1.0, 4, 1.0, 1), (0, 0, 0, 17, 0.1, 15, 0.0, 30, 0.0, 1),
    (0, 0, 0, 5, 0.0, 60, 0.0, 45, 0.0, 1), (0, 0, 0, 3, 0.0, 40, 0.0, 70, 0.0, 1), (0, 0, 0, 8, 0.2, 35, 0.0, 25, 0.0, 1),
    (0, 0, 0, 2, 0.0, 20, 0.0, 19, 0.0, 1), (0, 0, 0, 6, 0.0, 50, 0.0, 0, 0.0, 1), (0, 0, 0, 4, 0.0, 22, 0.0, 3, 0.0, 1),
    (0, 0, 1, 6, 0.0, 3, 1.0, 60, 0.0, 1), (0, 0, 1, 8, 0.0, 0, 0.0, 25, 0.0, 1), (0, 0, 1, 3, 0.0, 5, 1.0, 40, 0.0, 1),
    (0, 0, 0, 2, 1.0, 20, 0.0, 1, 1.0, 0), (0, 0, 0, 1, 1.0, 30, 0.0, 0, 0.0, 0), (0, 0, 0, 3, 1.0, 2, 1.0, 0, 0.0, 0),
    (0, 0, 0, 2, 0.5, 20, 0.0, 2, 1.0, 0), (0, 0, 0, 4, 0.8, 40, 0.0, 1, 1.0, 0), (0, 0, 0, 1, 1.0, 0, 0.0, 2, 1.0, 0),
    (0, 0, 0, 30, 0.0, 20, 0.0, 3, 1.0, 1), (0, 0, 0, 18, 0.1, 0, 0.0, 4, 1.0, 1), (0, 0, 0, 45, 0.0, 5, 0.0, 2, 1.0, 1),
    (0, 0, 0, 18, 0.0, 40, 0.0, 1, 1.0, 1), (0, 0, 0, 24, 0.2, 3, 1.0, 2, 1.0, 1), (0, 0, 0, 6, 0.0, 50, 0.0, 4, 1.0, 0),
    (0, 0, 0, 12, 0.0, 3, 0.0, 5, 1.0, 0), (0, 0, 0, 70, 0.3, 0, 0.0, 6, 1.0, 1), (0, 0, 0, 3, 0.0, 30, 0.0, 2, 0.9, 0),
    (0, 0, 1, 1, 0.0, 2, 1.0, 20, 0.0, 1), (0, 0, 1, 1, 0.0, 0, 0.0, 18, 0.0, 1), (0, 0, 1, 2, 0.0, 9, 0.0, 30, 0.1, 1),
    (0, 0, 1, 12, 0.0, 1, 1.0, 22, 0.0, 1), (0, 0, 1, 2, 0.0, 60, 0.0, 17, 0.0, 1), (0, 0, 1, 3, 0.3, 3, 1.0, 90, 0.0, 1),
    (0, 0, 1, 4, 0.0, 30, 0.0, 3, 1.0, 0), (0, 0, 1, 2, 0.0, 2, 1.0, 2, 1.0, 0), (0, 0, 1, 5, 1.0, 40, 0.0, 4, 1.0, 0),
    (0, 0, 0, 4, 0.0, 3, 1.0, 2, 1.0, 0), (0, 0, 0, 6, 0.0, 2, 0.0, 5, 0.0, 0), (0, 0, 0, 3, 0.0, 0, 0.0, 60, 0.0, 0),
    (0, 0, 0, 9, 0.0, 8, 1.0, 40, 0.0, 0), (0, 0, 0, 2, 0.0, 1, 0.0, 30, 0.0, 0), (0, 0, 0, 7, 0.0, 4, 0.5, 22, 0.0, 0),
    (0, 0, 0, 3, 1.0, 50, 0.0, 60, 0.0, 0), (0, 0, 0, 12, 0.7, 30, 0.0, 30, 0.0, 0), (0, 0, 0, 30, 0.9, 2, 1.0, 3, 1.0, 0),
    (0, 0, 0, 25, 0.5, 20, 0.6, 18, 0.7, 0), (0, 0, 0, 60, 0.6, 5, 1.0, 4, 1.0, 0), (0, 0, 0, 5, 1.0, 5, 1.0, 5, 1.0, 0),
]


@cache
def tree() -> tuple:
    """The decision tree: a label, or (column, limit, tree up to the limit, tree above it)."""
    rows = np.array(LABELLED, float)
    return _grow(rows[:, :-1], rows[:, -1].astype(int))


def _grow(x: np.ndarray, y: np.ndarray):
    if len(set(y)) == 1:
        return int(y[0])
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, column] <= limit
            impure = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impure < best[0] - 1e-9:
                best = impure, column, limit
    if best is None:
        return int(y.mean() >= 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), _grow(x[low], y[low]), _grow(x[~low], y[~low])


def is_main(block: tuple) -> bool:
    node = tree()
    while not isinstance(node, int):
        node = node[2] if block[node[0]] <= node[1] else node[3]
    return bool(node)


# Of those, the ones that matter on an article element itself; an article's own header has its title.
ARTICLE_WORDS = frozenset("ad ads advert advertisement promo sponsored comment comments related teaser".split())


def _names(value: str, marked: frozenset[str]) -> bool:
    """Whether one of the names ends in a marked word, but for words of place and kind, and is not that of a state."""
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if any(w in marked and not STATES_BEFORE & set(words[:i]) and all(v in PARTS or v in marked for v in words[i + 1:])
               for i, w in enumerate(words)):
            return True
    return False


def _is_region(tag: str, marks: str, in_article: bool) -> int:
    """1 for a region, 2 for one by its class or id only, 0 for none."""
    if tag in REGIONS and not (tag == "header" and in_article):
        return 1
    if not marks or tag in ("html", "body", "main"):
        return 0
    named = 0
    marked = ARTICLE_WORDS if tag == "article" else REGION_WORDS - {"header"} if in_article else REGION_WORDS
    for name, *values in _MARKS.findall(marks):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 1
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 1
        if name == "role" and value.lower() in REGION_ROLES:
            return 1
        if name in ("class", "id") and tag not in HEADINGS and _names(value, marked):
            named = 2
    return named


def _is_content(tag: str, marks: str) -> bool:
    return bool(marks) and tag in ("div", "section", "td") and any(
        name.lower() in ("class", "id") and any(w.lower() in CONTENT_WORDS for w in _NAME.findall("".join(values)))
        or name.lower() == "role" and "".join(values).lower() == "main" for name, *values in _MARKS.findall(marks))


def blocks(page: str) -> list[tuple[str, int, int, bool, int, int, int]]:
    """Text blocks in page order: text, regions, links' words, heading, and how many article, main and other
    content elements they lie in."""
    out: list[tuple] = []
    # Open elements: tag, whether it is a region (2: by name), whether it is marked as content.
    stack: list[tuple[str, int, bool]] = []
    # Open regions by name, by number; how many of them are around each open element that may hold the main text.
    named: list[int] = []
    around: list[int] = []
    numbers = 0
    places: list[tuple[tuple[int, ...], int]] = []
    counts = {"region": 0, "article": 0, "main": 0, "content": 0, "a": 0, "unseen": 0, "heading": 0}
    parts: list[str] = []
    linked: list[str] = []

    def count(tag: str, region: int, content: bool, by: int) -> None:
        nonlocal numbers
        counts["region"] += by * (region == 1)
        if region == 2 and by > 0:
            numbers += 1
            named.append(numbers)
        elif region == 2:
            named.pop()
        elif not region and (content or tag in ("article", "main")):
            around.append(len(named)) if by > 0 else around.pop()
        counts["content"] += by * content
        if tag in ("article", "main", "a"):
            counts[tag] += by
        counts["unseen"] += by * (tag in UNSEEN)
        counts["heading"] += by * (tag in HEADINGS)

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, counts["region"], len("".join(linked).split()), counts["heading"] > 0,
                        counts["article"], counts["main"], counts["content"]))
            places.append((tuple(named), around[-1] if around else 0))
        parts.clear()
        linked.clear()

    def words(raw: str) -> None:
        if stack and stack[-1][0] == "head" and not raw.isspace() and raw:
            pop()
        if raw and not counts["unseen"]:
            text = html.unescape(raw)
            parts.append(text)
            if counts["a"]:
                linked.append(text + " ")

    def pop() -> None:
        count(*stack.pop(), -1)

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        words(page[at:token.start() if token else len(page)])
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        elif tag in ("br", "img", "input"):
            parts.append(" " if tag == "br" else "")
        if token[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
            continue
        # A head ends with what cannot be in one; what is in a template stays there.
        if tag not in IN_HEAD and stack and (stack[-1][0] == "head" or tag == "body"):
            open_ = [t for t, *_ in stack]
            if "head" in open_ and "template" not in open_:
                while len(stack) > open_.index("head"):
                    pop()
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            # A paragraph ends where another block starts, a list item at the next item.
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and any(t == "p" for t, *_ in stack)):
                pop()
            if tag in ("li", "dt", "dd") and stack and stack[-1][0] in ("li", "dt", "dd"):
                pop()
        elif tag == "a" and stack and stack[-1][0] == "a":
            pop()
        if tag in ("article", "main"):
            # A form around the article is the page's own, not a form in it.
            for i, (other, flagged, content) in enumerate(stack):
                if other == "form" and flagged:
                    stack[i] = other, 0, content
                    counts["region"] -= 1
        region = _is_region(tag, token[3], counts["article"] > 0)
        stack.append((tag, region, not region and _is_content(tag, token[3])))
        count(*stack[-1], 1)
        if token[3].endswith("/") and tag in ("svg", "math"):
            pop()
    close()
    # Unless main text is outside of them, named regions around the least enclosed main text are wrappers.
    holders = [(block, *place) for block, place in zip(out, places) if any(block[4:]) and not block[1]]
    wrappers: set[int] = set()
    if not any(not names for _, names, _ in holders):
        inside = [names for _, names, outer in holders if len(names) == outer]
        least = min(map(len, inside), default=0)
        wrappers.update(*(names for names in inside if len(names) == least))
    return [(text, region + sum(n not in wrappers for n in names), *rest)
            for (text, region, *rest), (names, _) in zip(out, places)]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    # The article elements hold the main text, or else the main element, or else one marked as content, or none does.
    depth = next((d for d in (4, 5, 6) if any(b[d] and not b[1] for b in found)), None)
    sizes = [(len(b[0].split()),) for b in found]
    shape = [(n, min(1.0, b[2] / n)) for (n,), b in zip(sizes, found)]
    kept = []
    for i, (text, regions, _, heading, *depths) in enumerate(found):
        inside = 0 if depth is None else 1 if depths[depth - 4] else -1
        before = shape[i - 1] if i else (0, 0.0)
        after = shape[i + 1] if i + 1 < len(found) else (0, 0.0)
        if is_main((regions, inside, int(heading), *shape[i], *before, *after)):
            kept.append(text)
    if not kept and depth is None:
        # Neither an article nor a block that is long enough: a short page is all there is.
        kept = [text for (text, regions, *_), (_, links) in zip(found, shape)
                if not regions and links <= 0.5 and any(map(str.isalnum, text))]
    return " ".join(kept)


def extract(df: DataFrame, source: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) of every page; taken names get an underscore."""
    text, size = free_names(df, "text", "n_chars")
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType()), T.StructField(size, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, source)):
            texts = [main_text(p) for p in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            yield (batch.append_column(text, pa.array(texts, pa.string()))
                   .append_column(size, pa.array([len(t) for t in texts], pa.int64())))

    return df.mapInArrow(add, schema)
