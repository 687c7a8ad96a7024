"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Every line has a weight: the
length of its text, or zero where its markup says that it is not part of an article.
The weights are summed over sliding windows of lines; a window sum that rises above a
threshold is a surge point, one that falls back to it is a dive point, and the text
between a surge and its dive is kept.

Every page goes this way; markup only raises or lowers weights. Text in links weighs nothing,
furniture is left out of the windows, and the threshold is a share of the page's largest window
sum, so that short lines away from running text are dropped. Where a page has an article or
main element, a line in it that has text outside links weighs ``RAISED`` more, so that its
short lines stay, and a window of empty lines stands for what is outside of it. Lists of links
of a window's length or more are then dropped, in an article as elsewhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines whose weights are summed for one point of the distribution.
WINDOW = 3
# The threshold: this share of the largest window sum, and at most so many characters.
SHARE, MOST = 0.25, 60
# What a line of an article weighs besides its length.
RAISED = MOST + 1
# Names of classes and ids are overruled where they leave less than this share of a page's text.
OVERRULED = 0.1

# --- fixed values: names of HTML and of common page furniture ---------------

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|select|object|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?"
    r"(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog head button fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comment-list"
    " consent cookie cookies copyright disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter"
    " notice notices pagination pager popup promo promos promotion related replies reply share sharing sidebar side-bar"
    " skip skip-link social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# What class names of furniture begin with.
FURNITURE_PREFIXES = tuple(
    "ad- ads- advert- breadcrumb- comment- comments- consent- cookie- footer- gdpr- nav- newsletter- pagination- related- share- sponsored-".split()
)
# Names of elements whose articles are not the page's own.
HOLDS_OTHERS = frozenset("comment comments comment-list disqus related replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that the start of another block closes when their end tag is left out.
_CLOSES_PARAGRAPH = BLOCKS
# ---------------------------------------------------------------------------


# Why a line is furniture, from weak to strong: an element with such a name, one whose articles are not the page's own, its tags.
NAMED, OTHERS, TAGGED = 1, 2, 3


def _furniture(tag: str, attributes: str) -> int:
    if tag in FURNITURE_TAGS:
        return TAGGED
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "aria-label"):
            for w in value.replace("_", "-").split():
                if w in FURNITURE_WORDS or w.startswith(FURNITURE_PREFIXES):
                    found = max(found, OTHERS if w in HOLDS_OTHERS else NAMED)
        elif name == "role":
            if value in FURNITURE_ROLES:
                return TAGGED
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                return TAGGED
        elif name == "hidden" or value == "true":
            return TAGGED
    return found


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, is furniture, is inside an article) of every block of a page, in page order.

    Character references are decoded and white space becomes single spaces. Blocks
    without text are empty lines, so that they separate what stands around them.
    """
    return [(text, dull > 0, inside) for text, dull, inside, _, _ in blocks_of(page)]


def blocks_of(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """The lines of ``lines_of`` with why they are furniture, the length of their text outside links, and whether they are headings.

    A name of an element that contains an article or main says nothing about that article.
    """
    out: list[tuple[str, int, bool, int, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    dull, inside, link = 0, False, False
    where = 0

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        in_links = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
        parts.clear()
        linked.clear()
        out.append((text, dull, inside, max(len(text) - in_links, 0), bool(stack) and any(x[0] in HEADINGS for x in stack[-2:])))

    def add(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text)

    def leave(depth: int) -> None:
        nonlocal dull, inside
        del stack[depth:]
        dull, inside = stack[-1][1:] if stack else (0, False)

    for m in _TAG.finditer(page):
        if m.start() > where:
            add(page[where : m.start()])
        where = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                add(" ")
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "a":
                link = not m[2]
            if tag == "br":
                add("\n")
            elif not m[2] and tag not in VOID and (own := _furniture(tag, m[4])):
                end_line()
                dull = max(dull, own)
                stack.append((tag, dull, inside))
            elif m[2]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in BLOCKS:
                        break
                    if stack[depth][0] == tag:
                        end_line()
                        leave(depth)
                        break
            continue
        end_line()
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
        elif tag not in VOID and not m[4].endswith("/"):
            depth = len(stack)
            while depth and stack[depth - 1][0] not in BLOCKS:
                depth -= 1
            if depth and stack[depth - 1][0] == "p" or depth and tag == "li" and stack[depth - 1][0] == "li":
                leave(depth - 1)
            if tag in ("article", "main"):
                if not inside and dull == NAMED:
                    dull = 0
                inside = True
            if not (inside and tag == "header"):
                dull = max(dull, _furniture(tag, m[4]))
            stack.append((tag, dull, inside))
    if where < len(page):
        add(page[where:])
    end_line()
    return out


def surges(weights: list[int], window: int = WINDOW, threshold: float = 0) -> list[tuple[int, int]]:
    """Half-open line ranges between each surge point and its dive point.

    The window of line i holds lines i to i + window - 1. A surge is a line that weighs more
    than its part of the threshold, where the window sum is above the threshold; the dive is
    the line from which a whole window is not.
    """
    found = []
    n = len(weights)
    total = sum(weights[:window])
    start = None
    for i in range(n):
        if start is None:
            if total > threshold and weights[i] > threshold / window:
                start = i
        elif total <= threshold:
            found.append((start, i))
            start = None
        total += (weights[i + window] if i + window < n else 0) - weights[i]
    if start is not None:
        found.append((start, n))
    return found


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by an empty line; empty for null or empty pages."""
    if not page:
        return ""
    lines = [x for x in blocks_of(page) if x[0]]

    def mass(limit: int, within: bool) -> int:
        return sum(len(text) for text, dull, inside, _, _ in lines if dull < limit and inside >= within)

    marked = mass(TAGGED, True) > 0
    limit = NAMED
    if mass(NAMED, marked) <= (0 if marked else OVERRULED * mass(TAGGED, False)):
        limit = TAGGED  # names are overruled
    chosen: list[tuple[str, int, bool]] = []  # text, weight, is a heading
    for text, dull, inside, outside_links, heading in lines:
        if marked and not inside:
            chosen += [("", 0, False)] * WINDOW
        elif dull < limit:
            raised = RAISED if marked and outside_links else 0
            chosen.append((text, outside_links + raised, heading))
    weights = [x[1] for x in chosen]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    threshold = min(SHARE * max(sums, default=0), MOST)
    kept, last = [], 0
    for begin, end in surges(weights, WINDOW, threshold):
        while begin > last and chosen[begin - 1][2]:  # headings belong to the text after them
            begin -= 1
        kept += [chosen[i][0] for i in range(begin, end)]
        last = end
    return "\n\n".join(x for x in kept if x)


def extract_text(pages: DataFrame, html_col: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``output``.

    Every row stays. Null and empty pages get an empty text; an input column named
    like ``output`` is replaced. Runs in the scan's tasks, one page at a time.
    """
    kept = [c for c in pages.columns if c != output]
    body = F.col(f"`{html_col}`").alias("__page")
    rest = [F.col(f"`{c}`") for c in kept if c != html_col]

    @F.arrow_udf("string")
    def texts(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([main_text(p) for p in batch.to_pylist()], pa.string())

    return pages.select(*rest, body).select(*[c for c in kept if c != html_col], texts("__page").alias(output))
