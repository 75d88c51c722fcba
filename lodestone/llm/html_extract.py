"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block element, in page order. Lines inside boilerplate elements (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) are taken out. A line's weight is the length of its text
outside links, and weights are summed over sliding windows of WINDOW lines. Where the sums rise from nothing the text
surges, where they fall back to nothing it dives; a stretch between the two is kept if one of its windows reaches
SURGE, or the page's largest window where that is smaller. All such stretches are kept, so menus of links part the
text but do not end it, and short leftovers beyond them (a copyright line, "share this") go. A short line with text of its own
that shares its container with a surging line is no leftover: the article may end with a short paragraph behind a menu; one behind
the text and outside its containers is.

If the page marks its article (article, main, role=main), lines outside the mark are no part of the distribution. Inside it
only list items count as menus: other lines weigh their links too, and all lines with weight are kept.

Class words are weighed, not believed. A class that names a state (has-sidebar, no-comments, page-with-header) says nothing. A
word of the page's frame (sidebar, menu, footer) does not count on an element that holds the article's mark or, by far,
most of the page's text: that is the wrapper. A word of added matter (adverts, notices) counts unless no other text of
the page surges; words of readers' comments always do. Words that articles have too (story related, social history) count only if the rest surges or
outweighs them.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
IN_TAG = re.compile(r"[>\"']")
HINT = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template textarea title iframe xmp".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select object canvas svg head".split())
ENDED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
# Blocks that are a line of the element around them.
LINES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote address figcaption caption legend summary hr".split())
# Class words by what they name: the page's frame, added matter, readers' comments, and what may be that or an article.
FRAME = frozenset("sidebar breadcrumb breadcrumbs menu nav navbar navigation footer popup modal masthead toolbar pagination pager".split())
ADDED = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsored cookie cookies consent newsletter subscribe login signup".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
DOUBTFUL = frozenset(
    "sponsor promo promotion banner notice notices alert subscription share sharing social related recommended overlay widget search "
    "complementary contentinfo discussion reactions responses feedback".split()
)
# A class with one of these words tells the state of what it stands on.
STATES = frozenset("has no not with without is on off hide hidden show open opened close closed free enabled disabled sticky fixed layout page body wrapper container template theme type".split())
# A wrapper holds at least so many times the text outside all hinted elements.
WRAPPER = 4


@dataclass
class Hint:
    """An element whose class or tag suggests boilerplate, and what it turned out to hold."""

    kind: str  # frame, added or comments
    parent: int  # number of the hinted element around it, -1 if none
    text: int = 0
    marked: bool = False


@dataclass
class Line:
    text: str
    plain: int  # code points outside links
    item: bool  # of a list
    boilerplate: bool  # by a tag that says so
    doubtful: bool  # boilerplate by a class word that articles have too
    article: bool
    hint: int = -1  # number of the innermost hinted element around it
    place: int = 0  # number of the element that the line's own block stands in; 0 for none but the page


@dataclass
class Element:
    tag: str
    boilerplate: bool
    doubtful: bool
    article: bool
    hinted: str = ""  # a kind of hint
    hint: int = -1
    number: int = 0
    inline: Counter = field(default_factory=Counter)  # open inline elements directly within this block


def class_words(value: str) -> set[str]:
    """The words of a class, id or role, but for those of names that tell a state."""
    names = [WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) for name in value.split()]
    return {w for words in names if len(words) == 1 or not STATES.intersection(words) for w in words}


def element(tag: str, attributes: str, in_article: bool) -> Element:
    """What an element says about its text, by its tag and the words of its class, id and role."""
    hints: set[str] = set()
    role = ""
    for m in HINT.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        hints |= class_words(value)
        if m[1].lower() == "role":
            role = value.lower()
    article = tag in ("article", "main") or role in ("main", "article")
    if tag in ("html", "body", "main"):
        return Element(tag, False, False, article)
    outside = not in_article and not article
    head = tag == "header" or role == "banner"
    sure = (tag in BOILERPLATE and tag != "form") or (head and outside)
    frame = tag == "form" or bool(hints & FRAME) or ("header" in hints and outside)
    hinted = "" if sure else "comments" if hints & COMMENTS else "added" if hints & ADDED else "frame" if frame else ""
    return Element(tag, sure, bool(hints & DOUBTFUL) and not article, article and not sure and not hinted, hinted)


def tag_end(page: str, at: int) -> int:
    """The position of the > that ends a tag, quoted values skipped; -1 if none. A quote that is never closed ends
    nothing: there is no further one of its kind, so each page meets that at most twice."""
    m = IN_TAG.search(page, at)
    while m and m[0] != ">":
        close = page.find(m[0], m.end())
        m = IN_TAG.search(page, close + 1 if close >= 0 else m.end())
    return m.start() if m else -1


def raw_end(page: str, tag: str, at: int) -> int:
    """The position behind the closing tag of an element whose content is no markup; the page's end if none."""
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


class Reader:
    """Turns one page into lines, in one pass from its first character to its last."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack = [Element("", False, False, False)]
        self.blocks = [self.stack[0]]
        self.open: Counter = Counter()
        self.boilerplate = self.doubtful = self.article = self.items = 0
        self.hints: list[Hint] = []
        self.hint = -1  # the innermost open one
        self.numbered = 0
        self.skipped = 0  # open inline elements of boilerplate, whose text is left out of its line
        self.link_at = 0  # stack height at which a link is open; 0 if none

    def add(self, raw: str) -> None:
        if self.skipped:
            return
        text = html_lib.unescape(raw)
        self.parts.append(text)
        if self.link_at:
            self.linked += len(SPACE.sub(" ", text).strip())

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            plain = max(0, len(text) - self.linked)
            inner = self.blocks[-1]
            around = inner if len(self.blocks) < 2 or inner.tag not in LINES else self.blocks[-2]
            place = 0 if around.tag in ("", "html", "body") else around.number
            self.lines.append(Line(text, plain, self.items > 0, self.boilerplate > 0, self.doubtful > 0, self.article > 0, self.hint, place))
            if self.hint >= 0 and not self.boilerplate:
                self.hints[self.hint].text += plain
        self.parts.clear()
        self.linked = 0

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.open[e.tag] += 1
        self.numbered += 1
        e.number = self.numbered
        if e.hinted and (e.tag in BLOCKS or e.tag in BOILERPLATE):
            self.hints.append(Hint(e.hinted, self.hint))
            e.hint = self.hint = len(self.hints) - 1
        if e.article and self.hint >= 0 and not self.boilerplate:
            self.hints[self.hint].marked = True
        self.count(e, 1)
        if e.tag in BLOCKS or e.tag in BOILERPLATE:
            self.blocks.append(e)
        else:
            self.blocks[-1].inline[e.tag] += 1

    def count(self, e: Element, by: int) -> None:
        if e.tag not in BLOCKS and e.tag not in BOILERPLATE:
            self.skipped += by * (e.boilerplate or e.doubtful or e.hinted != "")
            return
        self.boilerplate += by * e.boilerplate
        self.doubtful += by * e.doubtful
        self.article += by * e.article
        self.items += by * (e.tag == "li")

    def pop(self) -> Element:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        self.count(e, -1)
        if e.hint >= 0:
            self.hint = self.hints[e.hint].parent
        if e is self.blocks[-1]:
            self.blocks.pop()
        else:
            self.blocks[-1].inline[e.tag] -= 1
        if len(self.stack) < self.link_at:
            self.link_at = 0
        return e

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.link_at = len(self.stack)
        if tag == "a" or tag in VOID:
            return
        block = tag in BLOCKS or tag in BOILERPLATE
        if tag in ENDED_BY_NEXT and self.blocks[-1].tag == tag:
            while self.pop().tag != tag:
                pass
        # An inline element matters only if it says something: bold text and such need no entry.
        e = element(tag, attributes, self.article > 0)
        if not attributes.endswith("/") and (block or e.boilerplate or e.doubtful or e.hinted or self.blocks[-1].inline[tag]):
            self.push(e)

    def end(self, tag: str) -> None:
        block = tag in BLOCKS or tag in BOILERPLATE
        if tag == "a":
            self.link_at = 0
        if self.open[tag] if block else self.blocks[-1].inline[tag]:
            while self.pop().tag != tag:
                pass

    def read(self, page: str) -> list[Line]:
        """The page's lines; those of hinted elements that turn out to be boilerplate are marked so."""
        self.scan(page)
        drops = dropped(self.hints, self.lines)
        for x in self.lines:
            x.boilerplate = x.boilerplate or (x.hint >= 0 and drops[x.hint])
        return self.lines

    def scan(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.add(page[at:])
                break
            m = NAME.match(page, lt + 1)
            if not m and page[lt + 1 : lt + 2] not in ("!", "?"):  # a lone < is text
                self.add(page[at : lt + 1])
                at = lt + 1
                continue
            if lt > at:
                self.add(page[at:lt])
            if not m:
                comment = page.startswith("<!--", lt)
                end = page.find("-->" if comment else ">", lt + 2)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            end = tag_end(page, m.end())
            if end < 0:  # cut off inside a tag
                break
            at = end + 1
            tag = m[2].lower()
            if tag in BLOCKS or tag in BOILERPLATE:
                self.flush()
            if m[1]:
                self.end(tag)
            elif tag in DROPPED:
                at = at if page[end - 1] == "/" else raw_end(page, tag, at)
            else:
                self.start(tag, page[m.end() : end])
        self.flush()


def dropped(hints: list[Hint], lines: list[Line]) -> list[bool]:
    """Whether each hinted element's text goes, by what it holds and what stands outside all of them."""
    for h in reversed(hints):  # elements around one come before it
        if h.parent >= 0:
            hints[h.parent].text += h.text
            # A mark within added matter (a comment may be an article) is no mark of the page.
            hints[h.parent].marked |= h.marked and h.kind == "frame"
    free = [x.plain for x in lines if x.hint < 0 and not x.boilerplate and not x.doubtful]
    outside, surges = sum(free), max(windows(free), default=0) >= SURGE
    every = sum(x.plain for x in lines if not x.boilerplate)
    marked = any(x.article and not x.boilerplate for x in lines)
    out: list[bool] = []
    for h in hints:
        most = 2 * h.text > every
        if h.kind == "frame":
            wraps = h.marked or (most and (not surges or h.text >= WRAPPER * outside))
        else:
            wraps = h.kind == "added" and most and not surges and h.text > WRAPPER * outside and not marked
        out.append(not wraps or (h.parent >= 0 and out[h.parent]))
    return out


def lines_of(page: str) -> list[Line]:
    """The page's block texts in order, white space folded, references decoded; empty blocks are left out."""
    return Reader().read(page)


def windows(weights: list[int]) -> list[int]:
    """The sum of each line's weight and those of the next WINDOW - 1 lines."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def regions(weights: list[int], surge: int = SURGE) -> list[tuple[int, int]]:
    """[surge, dive) line ranges: from the first to the last line with weight of each stretch without a window of
    weight 0, if a window that starts in it reaches ``surge``, or the largest window of all where that is smaller."""
    sums = windows(weights)
    level = min(surge, max(sums, default=0))
    out, i, n = [], 0, len(weights)
    while i < n:
        if weights[i]:
            j = end = i
            while j < n and sums[j]:
                end = j + 1 if weights[j] else end
                j += 1
            if max(sums[i:end]) >= level:
                out.append((i, end))
            i = j
        else:
            i += 1
    return out


def without_doubtful(lines: list[Line]) -> list[Line]:
    """The lines without those of doubtful class words, unless these hold the page's text: the rest neither surges nor has
    more text outside links."""
    rest = [x for x in lines if not x.doubtful]
    weigh = lambda some: [x.plain for x in some]
    if max(windows(weigh(rest)), default=0) >= SURGE or sum(weigh(rest)) >= sum(weigh(x for x in lines if x.doubtful)):
        return rest or lines
    return lines


def main_text(page: str | None, surge: int = SURGE) -> str:
    """The page's main text: blocks joined by newlines; empty for a null or empty page or one without main text."""
    lines = [x for x in lines_of(page or "") if not x.boilerplate]
    marked = any(x.article for x in lines)
    if marked:
        lines = [x for x in lines if x.article]
    lines = without_doubtful(lines)
    weights = [len(x.text) if x.article and not x.item else x.plain for x in lines]
    found = regions(weights, surge)
    inside = [False] * len(lines)
    for a, b in found:
        inside[a:b] = [True] * (b - a)
    # Containers of the text: a short line in one of them is the text's own, before, between and behind its stretches.
    places = {lines[i].place for a, b in found for i in range(a, b) if weights[i]} - {0}
    own = lambda i: weights[i] and (marked or lines[i].place in places or found[0][0] <= i < found[-1][1])
    kept = [i for i in range(len(lines)) if found and (inside[i] or own(i))]
    # Where long lines stand in containers, short ones behind the last of these and outside are the page's.
    heavy = {lines[i].place for i in kept if weights[i] >= surge} - {0}
    while heavy and not marked and weights[kept[-1]] < surge and lines[kept[-1]].place not in heavy:
        kept.pop()
    return "\n".join(lines[i].text for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty html gives an empty text; so does a page of boilerplate or of links only. Repeated rows stay.
    Other columns, whatever their names, are not read; an empty table gives no rows. Each page is read whole, in time
    linear in its length, in one Arrow map without any shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(scan, "page_id long, url string, text string, n_chars long")
