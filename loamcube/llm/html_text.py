"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

``html.parser`` streams a page's events. A block element begins a line; a line has the text up to the next
one and the number of tags met in it. Each line's ratio of text to tags is smoothed along the page by a
Gaussian, and the smoothed ratios are clustered in two about a threshold that moves until it lies midway
between the means of its sides (it starts at the mean). Stretches of lines above it, with short gaps between
them, are clusters of content; the one of most text decides where the article is:

* Elements that seem to be something else by tag, class, id or role (menus, headers, footers, forms, notices,
  comments) are set aside, but not if hardly any clustered text would be left: then the outermost that holds
  most of it is what it holds, whatever its name.
* The region is the ``article`` or ``main`` that holds most of the cluster, and all its lines are content, short
  ones between long ones too. Without one, it is the smallest element around all clusters of a tenth of its text or more, and
  then around what stands beside that in prose: lines that aren't links, nor much shorter than its own. In it, stretches
  of link lines below the threshold are menus.

Elements are numbered as they open, a parent before its children, so that all sums over them are single passes
and deep or long pages take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import binary_of

SIGMA = 1.0
# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select textarea fieldset datalist".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video option".split())
#: Lines below the threshold that a cluster may hold in a row, and link lines that make a menu.
GAP, MENU = 3, 3
#: Of the clustered text, what may be left at least when elements are set aside.
LEAST_LEFT = 0.1
#: Of the largest cluster's text, what another needs to be part of the article; of its lines' length, what prose beside it has.
LEAST_CLUSTER, BESIDE = 0.1, 0.2
#: Words in class, id or role that mark what isn't the article.
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|foot|masthead|site-header|page-header|toolbar|pagination|pager|share|sharing|social|related|recommend\w*|"
    r"comments?|comment-\w+|disqus|replies|respond|search|widget|tags?|copyright|legal|skip)(?:$|[\s_-])",
    re.I,
)
#: Class names that say how a wrapper is laid out, not what it is.
_LAYOUT_NAME = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)-\S+", re.I)
#: What a head may hold; anything else begins the body, as both tags of head may be left out.
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


@dataclass
class Line:
    """Text of one block, tags met in it, characters inside links, and the number of the element around it."""

    node: int
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Page(HTMLParser):
    """Lines of a page, and of each numbered element its parent, tag, and whether it seems to be something else."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.tags, self.doubtful = [0], ["html"], [False]
        self.open: list[tuple[str, bool, int]] = []  # tag, silent, number of the element around what follows
        self.blocks: list[int] = []  # places of the block elements in open
        self.tails: list[Counter] = [Counter()]  # inline elements open behind each block
        self.counts: Counter = Counter()
        self.silent = 0
        self.line: Line | None = None

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section in square brackets is no part of html: it ends with the next ``>``, whatever it holds."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _now(self) -> Line:
        if self.line is None:
            self.line = Line(self.open[-1][2] if self.open else 0)
            self.lines.append(self.line)
        return self.line

    def _doubtful(self, tag: str, attrs: list) -> bool:
        if tag == "header" and (self.counts["article"] or self.counts["main"]):
            # an article's own heading stays
            return False
        if tag in ASIDE:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attrs:
            if name == "aria-hidden" and value == "true":
                return True
            if value and (name == "role" and value.lower() in _ASIDE_ROLE or name in ("class", "id") and _ASIDE_NAME.search(_LAYOUT_NAME.sub("", value))):
                return True
        return False

    def _push(self, tag: str, silent: bool, number: int, block: bool) -> None:
        if block:
            self.blocks.append(len(self.open))
            self.tails.append(Counter())
        else:
            self.tails[-1][tag] += 1
        self.open.append((tag, silent, number))
        self.counts[tag] += 1
        self.silent += silent

    def _pop(self) -> str:
        tag, silent, _ = self.open.pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
            self.tails.pop()
        else:
            self.tails[-1][tag] -= 1
        self.counts[tag] -= 1
        self.silent -= silent
        return tag

    def _close(self, tag: str) -> None:
        """Close the innermost ``tag`` and what is open inside it; an inline one only up to the block around it."""
        if (self.tails[-1] if tag in INLINE else self.counts)[tag]:
            while self._pop() != tag:
                pass

    def _innermost(self, nth: int = 1) -> str:
        return self.open[self.blocks[-nth]][0] if len(self.blocks) >= nth else ""

    def _in_head(self) -> bool:
        return bool(self.open) and self.open[-1][0] == "head"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or tag not in _IN_HEAD and self._in_head():
            self._close("head")
        if tag in VOID:
            if self.line is not None:
                self.line.tags += 1
                if tag == "br":
                    self.line.parts.append(" ")
            return
        block, around = tag not in INLINE, self.open[-1][2] if self.open else 0
        hidden = any(n == "hidden" or n == "style" and v and _HIDDEN.search(v) for n, v in attrs) and tag not in ("html", "body")
        if tag in SILENT or hidden:
            self._push(tag, True, around, block)
            return
        if tag in _CLOSES_P and self._innermost() == "p":
            self._close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th") and tag in (self._innermost(), self._innermost(2) if self._innermost() == "p" else ""):
            self._close(tag)
        if block:
            self.line = None
            # the one around may have been closed
            self.parents.append(self.open[-1][2] if self.open else 0)
            self.tags.append(tag)
            self.doubtful.append(self._doubtful(tag, attrs))
            self._push(tag, False, len(self.tags) - 1, True)
        else:
            self._push(tag, False, around, False)
            if not self.silent:
                self._now().tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE and tag not in SILENT:
            self.line = None
        elif self.line is not None:
            self.line.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if data.strip() and self._in_head():
            self._close("head")
        if self.silent or (self.line is None and not data.strip()):
            return
        line = self._now()
        line.parts.append(data)
        if self.counts["a"]:
            line.linked += len(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends the kernel's part inside counts."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return total / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The value midway between the means of what lies at or above it and below it."""
    t = float(values.mean())
    for _ in range(50):
        high, low = values[values >= t], values[values < t]
        if not len(high) or not len(low):
            return t
        new = (float(high.mean()) + float(low.mean())) / 2
        if abs(new - t) < 1e-9:
            return new
        t = new
    return t


def clusters(high: np.ndarray, gap: int = GAP) -> list[tuple[int, int]]:
    """Stretches (first, one past the last) of lines above the threshold, with up to ``gap`` others between them."""
    at = np.flatnonzero(high)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, cut)]


def _within(page: _Page, own: np.ndarray) -> np.ndarray:
    """Sums over each element and all inside it."""
    total = own.copy()
    for n in range(len(total) - 1, 0, -1):
        total[page.parents[n]] += total[n]
    return total


def _set_aside(page: _Page, seed_text: np.ndarray) -> np.ndarray:
    """Elements that aren't the article's, themselves or by what is around them."""
    held = _within(page, seed_text)
    # what the outermost doubtful elements inside each element hold
    inner = np.zeros(len(held))
    for n in range(len(held) - 1, 0, -1):
        inner[page.parents[n]] += held[n] if page.doubtful[n] else inner[n]
    left, doubtful = held[0] - inner[0], list(page.doubtful)
    for n in range(1, len(held)):
        # elements of over half the text lie inside each other, so this goes from the outermost inwards
        if left < LEAST_LEFT * held[0] and doubtful[n] and held[n] > 0.5 * held[0]:
            doubtful[n], left = False, left + held[n] - inner[n]
    out = np.zeros(len(held), bool)
    for n in range(1, len(held)):
        out[n] = doubtful[n] or out[page.parents[n]]
    return out


def _around(page: _Page, lines: list, found: list[tuple[int, int]], sizes: list[float], per_node) -> int:
    """The smallest element around all clusters that matter, then around prose that stands beside it."""
    inside, part = np.arange(len(lines)), np.zeros(len(lines))
    for (a, b), size in zip(found, sizes, strict=True):
        if size >= LEAST_CLUSTER * max(sizes):
            part[(inside >= a) & (inside < b)] = 1
    held = _within(page, per_node(lines, part))
    region = max(n for n in range(len(held)) if held[n] >= held[0])
    count = _within(page, per_node(lines, np.ones(len(lines))))
    text = _within(page, per_node(lines, np.array([len(t) for _, t in lines], float)))
    plain = _within(page, per_node(lines, np.array([len(t) * (2 * x.linked <= len(t)) for x, t in lines], float)))
    outer = region
    while outer:
        outer = page.parents[outer]
        more, unlinked, n = text[outer] - text[region], plain[outer] - plain[region], count[outer] - count[region]
        if n and 2 * unlinked >= more and more / n >= BESIDE * text[region] / count[region]:
            region = outer
    return region


#: Decimal references with zeros in front, and those of more digits than any character has.
_ZEROS, _DIGITS = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")


def bounded_references(html: str) -> str:
    """``html`` with decimal character references that the parser can take: beyond the last character all mean the same."""
    return _DIGITS.sub("&#9999999", _ZEROS.sub("&#", html)) if "&#" in html else html


def main_text(html: str, sigma: float = SIGMA, by_ratio: bool = True) -> str:
    """Text of the article in a page: blocks in page order, joined by one newline.

    Without ``by_ratio`` every line counts as one above the threshold.
    """
    page = _Page()
    page.feed(bounded_references(html))
    page.close()

    def above(lines: list[tuple[Line, str]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(t) for _, t in lines], float)
        ratio = smoothed(length / (1 + np.array([x.tags for x, _ in lines])), sigma)
        return length, ratio >= threshold(ratio) if by_ratio else np.ones(len(lines), bool)

    def per_node(lines: list[tuple[Line, str]], text: np.ndarray) -> np.ndarray:
        return np.bincount([x.node for x, _ in lines], weights=text, minlength=len(page.tags)).astype(float)

    lines = [(x, t) for x in page.lines if (t := x.text)]
    if not lines:
        return ""
    length, high = above(lines)
    aside = _set_aside(page, per_node(lines, length * high))
    lines = [(x, t) for x, t in lines if not aside[x.node]]
    if not lines:
        return ""
    length, high = above(lines)
    found = clusters(high)
    sizes = [float((length * high)[a:b].sum()) for a, b in found]
    inside = np.arange(len(lines))
    first, last = found[int(np.argmax(sizes))]
    held = _within(page, per_node(lines, length * ((inside >= first) & (inside < last))))
    named = [n for n in range(len(held)) if page.tags[n] in ("article", "main") and held[n] >= 0.5 * held[0]]
    region = max(named) if named else _around(page, lines, found, sizes, per_node)
    own = np.zeros(len(held), bool)
    own[region] = True
    for n in range(region + 1, len(held)):
        own[n] = own[page.parents[n]]
    keep = np.array([own[x.node] for x, _ in lines])
    if not named:
        menu = keep & ~high & np.array([2 * x.linked > len(t) for x, t in lines])
        for a, b in clusters(menu, 0):
            if b - a >= MENU:
                keep[a:b] = False
    return "\n".join(t for (_, t), k in zip(lines, keep, strict=True) if k)


def page_text(html: Column | str) -> Column:
    """Main text of the html in a column; empty for null and for pages without any."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py().decode("utf-8", "replace")) for x in binary_of(column)], pa.string())

    return run(html)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``ht_text`` and ``ht_n_chars`` (its code points).

    Rows are read one by one: null and empty html give empty text, equal rows equal text, broken markup
    is read as far as it goes, what an unclosed element swallows ends with the element around it, and very long or
    deep pages take time in proportion. Columns named ``ht_*`` are replaced, all others stay.
    """
    out = pages.withColumn("ht_text", page_text(html_col))
    return out.withColumn("ht_n_chars", F.length("ht_text").cast("long"))
