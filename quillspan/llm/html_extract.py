"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard-library parser streams events; block-level tags end a line, so a line is one block
of text with the tags that belong to it. Its ratio is text characters over tags (link text does
not count); lines inside furniture - menus, headers, footers, side bars, notices, adverts, forms, reader
comments, known by tag, role or name - keep ``AGAINST`` of theirs. The ratios of all lines are smoothed
with a Gaussian over neighbours in page order and split into content and rest by threshold clustering
(two means in log space).

The region is the article or main element that holds ``HOLD`` of the text of the content lines outside furniture - within it the
deepest that holds as much - or, without one, the deepest element that holds all of these lines but outliers: those outside the deepest
element with ``HOLD`` of the text whose own ratio is below ``OUTLIER`` of the median inside. The result is every block of that region in
page order, short ones included, without furniture.

A name alone makes no furniture of an element that holds the article, the heading, or half of the page's text in several lines of running text (nine tenths in one line; reader
comments excepted), nor of one inside an article that has running text, if the name is one of many meanings (``_VAGUE``).

Null or empty html gives an empty text; a page of any length and depth is parsed whole, in time linear
in both; broken markup is read as the parser reads it. Elements of equal text: the deeper, then the
later one. Repeated pages are extracted each; columns other than page_id, url and html are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import map_batches

SIGMA = 1.0
#: Share of the content cluster's text that an article holds, or the core against which outliers are measured.
HOLD = 0.8
#: Share of the core's median ratio below which a content line elsewhere is an outlier.
OUTLIER = 0.5
#: Factor between the centres of two clusters; lines of one kind are not split.
APART = 2.0
#: Characters from which on a line is running text, and the most of them that may be links.
PROSE, LINKED = 60, 0.3
#: What furniture keeps of its ratios.
AGAINST = 0.1

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text: their content is not collected.
_SKIP = frozenset("head script style noscript template iframe svg button select textarea input audio video".split())
_FURNITURE = frozenset("nav footer aside form dialog".split())
#: Elements that are too small to be a region.
_INLINE = frozenset("p span b i em strong li td".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "widget widgets masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup cookie cookies consent gdpr notice notices notification popup modal overlay login toolbar pager pagination copyright".split()
)
_NAME_PARTS = re.compile(r"comments?(?!ar)|sidebar|advert|cookie|newsletter|breadcrumb|navbar|footer|masthead|sponsor")
#: Names of reader comments.
_COMMENTS = frozenset("comment comments commentlist usercomments disqus respond replies reply".split())
#: Names with other meanings: inside an article they need a second sign.
_VAGUE = frozenset("share sharing social related recommended recommendations copyright login signup widget widgets banner notice notices promo toolbar overlay popup subscription menu".split())
#: Names that mark furniture outside an article and parts of it inside.
_OUTSIDE = frozenset("header topbar hero".split())
#: Tags whose start ends an open paragraph, as browsers do.
_ENDS_P = _BLOCK - {"html", "head", "body", "title", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Tags that their own kind ends when it is still open.
_OWN_KIND = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects lines: (element, text, tags, link characters). Elements are (parent, tag, furniture).

    Furniture: 0 no, 1 by tag or role, 2 by name, 3 by a name that counts outside an article only, 4 by a name of
    reader comments, 5 by names of many meanings.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[int, str, int]] = [(-1, "", 0)]
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[int, str, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0
        self.silent = 0

    def _end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((self.stack[-1], text, self.tags, self.links))
            self.parts = []
            self.tags = self.links = 0

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.elements[self.stack.pop()][1]
            self.open[tag] -= 1
            self.silent -= tag in _SKIP

    def _find(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> int:
        """Depth of the innermost open element of these tags, not looking beyond ``within``; 0 if none."""
        if not any(self.open[tag] for tag in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[depth]][1]
            if tag in tags:
                return depth
            if tag in within:
                return 0
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self._end_line()
            if tag in _ENDS_P and (depth := self._find(("p",), ("article", "div", "section", "td", "th", "li", "blockquote"))):
                self._close(depth)
            if tag in _OWN_KIND and (depth := self._find((tag, "dt", "dd") if tag in ("dd", "dt") else (tag,), _OWN_KIND[tag])):
                self._close(depth)
            if tag not in ("head", "title", "html") and (depth := self._find(("head",))):
                self._close(depth)
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        kind = int(tag in _FURNITURE)
        named = 3 if tag == "menu" else 0
        for name, value in attrs:
            if name in ("class", "id") and value:
                names = _WORDS.findall(value.lower())
                marks = [w for w in names if w in _NAMES or _NAME_PARTS.search(w)]
                if marks or _NAME_PARTS.search(" ".join(names)):
                    comment = any(w in _COMMENTS or "comment" in w for w in names)
                    named = 4 if comment else 2 if named in (0, 3) and set(marks) - _VAGUE or named == 2 else named if named == 4 else 5
                elif not named and not _OUTSIDE.isdisjoint(names):
                    named = 3
            elif name == "role" and value:
                kind = kind or int(value.strip().lower() in _ROLES)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                kind = 1
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                kind = 1
        if tag in ("html", "body"):
            kind = named = 0
        elif tag in ("main", "h1"):
            named = 0
        self.elements.append((self.stack[-1], tag, kind or named))
        self.stack.append(len(self.elements) - 1)
        self.open[tag] += 1
        self.silent += tag in _SKIP

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self._end_line()
        if depth := self._find((tag,)):
            self._close(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCK:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.links += len(data)

    def finish(self) -> None:
        self.close()
        self._end_line()


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with a kernel of three sigmas, renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(max(-reach, -i), min(reach, len(values) - 1 - i) + 1):
            w = kernel[k + reach]
            total += w * values[i + k]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Boundary between the two clusters of the values (two means in log space); the least value if they lie within a factor of ``APART``."""
    logs = [math.log1p(v) for v in values]
    low, high = min(logs), max(logs)
    for _ in range(20):
        mid = (low + high) / 2
        a, b = [v for v in logs if v < mid], [v for v in logs if v >= mid]
        new = (sum(a) / len(a) if a else low, sum(b) / len(b) if b else high)
        if new == (low, high):
            break
        low, high = new
    return math.expm1((low + high) / 2) if high - low >= math.log(APART) else min(values)


def furniture(elements: list[tuple[int, str, int]], lines: list[tuple[int, str, int, int]]) -> list[bool]:
    """Whether each element is furniture or inside it. What holds the article, the heading, or half of all text in several lines of running text is a frame, whatever its name."""
    holds = [tag in ("main", "h1") or (tag == "article" and kind not in (2, 4)) for _, tag, kind in elements]
    prose, plain = [0] * len(elements), [0] * len(elements)
    for e, text, _, links in lines:
        prose[e] += len(text) >= PROSE and links <= LINKED * len(text)
        plain[e] += max(0, len(text) - links)
    for i in range(len(elements) - 1, 0, -1):
        parent = elements[i][0]
        holds[parent] |= holds[i]
        prose[parent] += prose[i]
        plain[parent] += plain[i]
    out, within = [False] * len(elements), [False] * len(elements)
    for i, (parent, tag, kind) in enumerate(elements):
        inner = parent >= 0 and within[parent]
        named = kind in (2, 4) or (kind == 5 and not (inner and prose[i])) or ((kind == 3 or tag == "header") and not inner)
        frame = holds[i] or (kind != 4 and prose[i] > 0 and plain[i] >= (0.5 if prose[i] > 1 else 0.9) * plain[0])
        out[i] = (parent >= 0 and out[parent]) or kind == 1 or (named and not frame)
        within[i] = inner or tag in ("article", "main")
    return out


def content(lines: list[tuple[int, str, int, int]], out: list[bool]) -> tuple[list[float], list[bool]]:
    """Text-to-tag ratio of each line, and whether it is content: smoothed, at or above the threshold of the two clusters."""
    ratio = [(AGAINST if out[e] else 1.0) * max(0, len(text) - links) / max(1, tags) for e, text, tags, links in lines]
    even = smooth(ratio)
    at = threshold(even)
    return ratio, [value >= at for value in even]


def _summed(elements: list[tuple[int, str, int]], own: list[int]) -> list[int]:
    """What each element and all elements in it have."""
    total = own[:]
    for i in range(len(elements) - 1, 0, -1):
        total[elements[i][0]] += total[i]
    return total


def region_of(elements: list[tuple[int, str, int]], found: list[tuple[int, int, float]], out: list[bool]) -> int:
    """The element whose blocks are the text; ``found`` has (element, characters, own ratio) of the content lines outside furniture."""
    depth = [0] * len(elements)
    for i, (parent, _, _) in enumerate(elements):
        depth[i] = depth[parent] + 1 if parent >= 0 else 0
    own = [0] * len(elements)
    for e, size, _ in found:
        own[e] += size
    mass = _summed(elements, own)
    if not mass[0]:
        return 0
    deepest = lambda some: max(some, key=lambda e: (depth[e], e), default=0)
    named = [e for e, (_, tag, _) in enumerate(elements) if tag in ("article", "main") and not out[e] and mass[e] >= HOLD * mass[0]]
    if named:
        outer = min(named, key=lambda e: depth[e])
        return deepest([e for e in named if mass[e] == mass[outer]])
    block = [tag not in _INLINE for _, tag, _ in elements]
    core = deepest([e for e in range(len(elements)) if block[e] and mass[e] >= HOLD * mass[0]])
    inside = _inside(elements, core)
    ratios = sorted(ratio for e, _, ratio in found if inside[e])
    least = OUTLIER * ratios[len(ratios) // 2]
    own = [0] * len(elements)
    for e, size, ratio in found:
        own[e] += size if inside[e] or ratio >= least else 0
    mass = _summed(elements, own)
    region = deepest([e for e in range(len(elements)) if block[e] and mass[e] == mass[0]])
    # The heading of the page belongs to the text even if it stands beside the region.
    parent = elements[region][0]
    if parent > 0 and elements[parent][1] != "body" and any(p == parent and tag == "h1" for p, tag, _ in elements):
        return parent
    return region


def _inside(elements: list[tuple[int, str, int]], region: int) -> list[bool]:
    """Whether each element is the region or in it."""
    inside = [False] * len(elements)
    for i, (parent, *_) in enumerate(elements):
        inside[i] = i == region or (parent >= 0 and inside[parent])
    return inside


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    elements, lines = parser.elements, parser.lines
    if not lines:
        return ""
    out = furniture(elements, lines)
    found = [(e, max(0, len(text) - links), ratio) for (e, text, _, links), ratio, is_content in zip(lines, *content(lines, out)) if is_content and not out[e]]
    inside = _inside(elements, region_of(elements, found, out))
    return "\n".join(text for e, text, _, _ in lines if inside[e] and not out[e])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(cols):
        text = [extract(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
