"""Main text of web pages from parser events and text-to-tag ratios.

One streaming pass of the standard parser turns a page into lines (blocks) with their characters, tags and link
characters. Ratios of characters to tags are smoothed by a Gaussian along the page; lines at or above a threshold
of the smoothed curve are clustered into content regions. All regions count, with the short lines (headings, short
paragraphs) of the elements that hold them and between them. Where a page names articles, the clusters decide where
an article's text begins and ends: runs of links before the first and after the last cluster go, prose stays.
Menus, form controls and the like are known by their elements and never count; a form, a class or an id name drops
an element only if its share of the text or its smoothed ratio is low. Time is linear in the page, however deep.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from fieldorder.llm.common import map_rows

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas dialog embed footer head iframe input label menu nav noscript object option script "
    "select style svg template textarea title video".split()
)
#: Elements that may be a region by themselves; others hold a line each.
HOLDERS = frozenset("article body center div html main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of their name, unless one of the others lies between.
SIBLINGS = frozenset("li td th tr dt dd".split())
FENCES = ("ul", "ol", "table", "tbody", "dl", "div", "section", "article")
#: Words of class and id names that mark what is not the article.
NAMED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login menu "
    "nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget widgets footer header masthead topbar "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended search "
    "toolbar pagination pager copyright".split()
)
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")


class Line:
    """``pieces``: text, its link characters, and the innermost open element that is suspect; ``node``: the block."""

    __slots__ = ("chars", "heading", "links", "node", "pieces", "tags", "text")

    def __init__(self, pieces: list, tags: int, node: int, heading: str):
        self.pieces, self.tags, self.node, self.heading = pieces, tags, node, heading
        self.settle()

    def settle(self) -> None:
        self.text = SPACE.sub(" ", "".join([x for x, _, _ in self.pieces])).strip()
        self.chars, self.links = len(self.text), sum([x for _, x, _ in self.pieces])

    @property
    def prose(self) -> bool:
        return 2 * self.links <= self.chars


class Lines(HTMLParser):
    """Collects lines; a line ends where a block begins or ends.

    Elements are numbered in page order, so an element and all it holds are one range of numbers. Lines and elements
    know the element around them and nothing further up: time and memory stay linear in the page however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kinds, self.parents = ["#page"], [0]
        self.open: list[tuple[int, bool, int, int]] = [(0, False, 0, 0)]  # element, dropped, block around, suspect around
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a name are
        self.around: list[int] = [0]  # a suspect's next suspect further up; 0: none
        self.lines: list[Line] = []
        self.buffer: list[tuple[str, int, int]] = []
        self.tags = 0

    def cut(self) -> None:
        if not self.buffer:
            return
        node = self.open[-1][2]
        line = Line(self.buffer, self.tags, node, self.kinds[node] if self.kinds[node] in HEADINGS else "")
        if line.text:
            self.lines.append(line)
            self.tags = 0
        self.buffer = []

    def dropped(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header" and not self.places.get("article") and not self.places.get("main"):
            return True
        if not attrs:
            return False
        a = {k: v or "" for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
            return True
        return "style" in a and "display:none" in a["style"].replace(" ", "").lower()

    def suspect(self, tag: str, attrs: list) -> bool:
        if tag == "form":
            return True
        a = {k: v or "" for k, v in attrs}
        if tag in HEADINGS or tag in ("html", "body", "main", "header"):
            return False
        if a.get("role", "").lower() == "form":
            return True
        if "class" not in a and "id" not in a:
            return False
        names = set(NAME.findall((a.get("class", "") + " " + a.get("id", "")).lower()))
        return bool(names & (READERS if tag == "article" else NAMED))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
            if self.places.get("p"):  # no block stays inside a paragraph
                self.close_to("p")
            if tag in SIBLINGS:
                self.close_sibling(tag)
        elif tag == "br":
            self.buffer.append((" ", 0, self.open[-1][3]))
        if tag in VOID:
            return
        up, skip, block, suspect = self.open[-1]
        skip = skip or self.dropped(tag, attrs)
        node = len(self.kinds)
        self.kinds.append(tag)
        self.parents.append(up)
        if not skip and (attrs or tag == "form") and self.suspect(tag, attrs):
            self.around.append(suspect)
            suspect = len(self.around) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((node, skip, node if tag in BLOCK else block, suspect))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_sibling(self, tag: str) -> None:
        mine = self.places.get(tag)
        if mine and all(not self.places.get(t) or self.places[t][-1] < mine[-1] for t in FENCES):
            self.close_to(tag)

    def close_to(self, tag: str) -> None:
        down = self.places[tag][-1]
        while len(self.open) > down:
            self.places[self.kinds[self.open.pop()[0]]].pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        if self.places.get(tag):
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if self.open[-1][1]:
            return
        self.buffer.append((data, len(data.strip()) if self.places.get("a") else 0, self.open[-1][3]))


def smoothed(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean over the neighbouring lines; the ends are weighted by what is there."""
    at = np.arange(-radius, radius + 1)
    w = np.exp(-(at**2) / (2 * sigma**2))
    return np.convolve(ratios, w, "full")[radius:-radius] / np.convolve(np.ones(len(ratios)), w, "full")[radius:-radius]


def curve(lines: list[Line]) -> np.ndarray:
    return smoothed(np.array([max(0, x.chars - x.links) / max(1, x.tags) for x in lines], float))


def threshold(ratio: np.ndarray, factor: float) -> float:
    return min(factor * ratio.std(), ratio.mean())


def without_suspects(lines: list[Line], around: list[int], factor: float, most: float) -> list[Line]:
    """Lines without the text of suspect elements whose share of the text is below ``most`` or whose ratio is low."""
    if len(around) == 1 or not lines:
        return lines
    chars = [0] * len(around)  # by innermost suspect, then summed up the tree; 0 stands for the page
    first, last = [len(lines)] * len(around), [-1] * len(around)
    for k, x in enumerate(lines):
        for text, _, e in x.pieces:
            chars[e] += len(text.strip())
            first[e], last[e] = min(first[e], k), max(last[e], k)
    for e in range(len(around) - 1, 0, -1):
        up = around[e]
        chars[up] += chars[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
    ratio = curve(lines)
    least = threshold(ratio, factor) * (1 - 1e-9)  # sums in another order must not put the page below its own mean
    before = np.concatenate([[0.0], np.cumsum(ratio)])
    gone = [False] * len(around)
    for e in range(1, len(around)):
        n = last[e] - first[e] + 1
        low = n > 0 and (before[last[e] + 1] - before[first[e]]) / n < least
        gone[e] = gone[around[e]] or chars[e] < most * chars[0] or low
    out, tags = [], 0
    for x in lines:
        x.pieces = [y for y in x.pieces if not gone[y[2]]]
        x.settle()
        tags += x.tags  # tags of what goes count for the next line
        if x.text:
            x.tags, tags = tags, 0
            out.append(x)
    return out


def inside(parents: list[int], roots: set[int]) -> list[int]:
    """For every element the outermost of ``roots`` around it (itself included), or 0."""
    out = [0] * len(parents)
    for n in range(1, len(parents)):
        out[n] = out[parents[n]] or (n if n in roots else 0)
    return out


def trimmed(lines: list[Line], core: list[bool]) -> list[Line]:
    """A region's lines without the runs of links before its first and after its last core line.

    A run begins at a heading or at the edge and goes if it has two lines of links or more and links are more than half
    of its characters. The main heading (h1) stays, as do single links and all prose, however short its lines are.
    """
    at = [k for k, c in enumerate(core) if c]
    if not at:
        return lines
    out: list[Line] = []
    for edge in (lines[: at[0]], None, lines[at[-1] + 1 :]):
        if edge is None:
            out += lines[at[0] : at[-1] + 1]
            continue
        runs: list[list[Line]] = []
        for x in edge:
            if x.heading or not runs:
                runs.append([])
            runs[-1].append(x)
        for run in runs:
            body = [x for x in run if not x.heading]
            links = sum(not x.prose for x in body) > 1 and 2 * sum(x.links for x in body) > sum(x.chars for x in body)
            out += [x for x in run if not links or x.heading == "h1"]
    return out


def main_text(html: str, factor: float = 1.0, share: float = 0.6, most: float = 0.5) -> str:
    """The article's lines joined by newlines; empty if there are none.

    ``factor``: the threshold is this many standard deviations of the smoothed ratios (or their mean, if less).
    ``share``: where the page names no article or main element, the short lines of the innermost element that holds
    this share of the content, in characters and in lines, are kept with all content lines and the lines between.
    ``most``: forms and elements with suspect names stay if they hold this share of the text at a ratio that is not low.
    """
    p = Lines()
    p.feed(html)
    p.close()
    p.cut()
    lines = without_suspects(p.lines, p.around, factor, most)
    if not lines:
        return ""
    kinds, parents = p.kinds, p.parents
    ratio = curve(lines)
    content = ratio >= threshold(ratio, factor)
    weight = [x.chars - min(x.chars, x.links) if c else 0 for x, c in zip(lines, content)]
    held, count, end, depth = [0] * len(kinds), [0] * len(kinds), list(range(len(kinds))), [0] * len(kinds)
    some = [False] * len(kinds)  # elements with lines
    for x, w in zip(lines, weight):
        held[x.node] += w
        count[x.node] += w > 0
        some[x.node] = True
    for n in range(len(kinds) - 1, 0, -1):
        up = parents[n]
        held[up] += held[n]
        count[up] += count[n]
        end[up] = max(end[up], end[n])
        some[up] = some[up] or some[n]
    named = [n for n in range(1, len(kinds)) if some[n] and kinds[n] in ("article", "main")]
    if named:
        # all articles with content; of a main that has articles, its own content lines and what lies between
        whole = {n for n in named if kinds[n] == "article" and held[n] > 0}
        main = {n for n in named if kinds[n] == "main" and held[n] > 0}
        if not whole:
            whole, main = main or {max(named, key=lambda n: (held[n], -n))}, set()
        region, beside = inside(parents, whole), inside(parents, main)
        kept: list[Line] = []
        for r, group in groupby(zip(lines, weight), key=lambda x: region[x[0].node]):
            mine = list(group)
            if r:
                kept += trimmed([x for x, _ in mine], [w > 0 and x.prose and not x.heading for x, w in mine])
            else:
                kept += [x for x, w in mine if w > 0 and x.prose and beside[x.node]]
        return "\n".join(x.text for x in kept)
    for n in range(1, len(kinds)):
        depth[n] = depth[parents[n]] + 1
    enough = share * count[0]
    fit = [n for n in range(1, len(kinds)) if some[n] and kinds[n] in HOLDERS and held[n] >= share * held[0] and count[n] >= enough]
    body = max(fit, key=lambda n: (depth[n], held[n])) if fit and held[0] else 0
    sure = [x.prose and (w > 0 or body <= x.node <= end[body]) for x, w in zip(lines, weight)]
    # an element with content lines holds its links and short lines, too, as far as they lie between content lines
    holder = [0] * len(kinds)
    for n in range(1, len(kinds)):
        holder[n] = n if kinds[n] in HOLDERS else holder[parents[n]]
    span: dict[int, tuple[int, int]] = {}
    for k, (x, w) in enumerate(zip(lines, weight)):
        if w > 0 and x.prose and holder[x.node]:
            span[holder[x.node]] = (span.get(holder[x.node], (k, k))[0], k)
    covered = np.zeros(len(lines) + 1, int)
    for a, b in span.values():
        covered[a] += 1
        covered[b] -= 1
    return "\n".join(x.text for x, ok, c in zip(lines, sure, np.cumsum(covered)) if ok or c > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of ``pages``.

    A null or empty page has an empty text, as has one without text outside dropped elements. Broken and cut-off
    markup is read as far as it goes. Repeated rows get a row each; other columns are not read.
    """

    def rows(part):
        for i, (html,) in enumerate(part):
            text = main_text(html) if html else ""
            yield i, text, len(text)

    return map_rows(pages, rows, ["html"], ["page_id", "url"], "text string, n_chars long")
