"""HTML extraction (9) by tag-path ratios.

Each text node has a path of tags from the root. Over a page, every path gets its text length
and its punctuation per node; both are smoothed over neighbouring paths in page order, fused,
and paths below a share of the best are no witnesses of content. The content is the smallest
element that holds nearly all of the witnesses' weight, or the article or main element around
it, and its ancestors as long as they add only headings, paragraphs and the like.

Tags and class names that usually hold something else are evidence. Menus, footers, asides, adverts
and reader comments are left out. Forms, page headers and boxes that only their class names mark are
left out unless they hold an article or main element, or most of the prose of a page without one.

A page is read in one pass from left to right, by steps whose cost is in proportion to what they
read; elements are numbered in page order, so that an element's content is a range of numbers.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setphrase.llm.common import whole_texts

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
# quotes count only after an equals sign; nothing is tried twice
REST = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>")
LOOSE = re.compile(r"[^<>]*+>")
NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
RAW = frozenset("script style noscript template iframe textarea svg select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags and names of other things than content: sure ones, and weaker ones.
OTHER = frozenset("head nav footer aside dialog menu object audio video canvas map button".split())
MAYBE = frozenset("form fieldset header".split())
OTHER_NAMES = re.compile(r"(?:nav\w*|menu|ads?|advert\w*|sponsor\w*|cookies?|consent|breadcrumbs?|footer|comments?|replies|disqus\w*|sidebar|contentinfo|complementary)(?:[-_].*)?|.*[-_](?:nav|navbar|menu|ads?|advert\w*|cookies?|consent|footer|comments?|sidebar)", re.I)
COMMENT_NAMES = re.compile(r"(?:comments?|replies|reply|disqus\w*)(?:[-_].*)?|.*[-_]comments?", re.I)
MAYBE_NAMES = re.compile(
    r"(?:promo\w*|banner\w*|notices?|alert|popup|modal|side|masthead|header|related|share|sharing|social|subscribe|newsletter|widget|toolbar|pagination|login|search\w*)"
    r"(?:[-_](?!by[-_]).*)?|.*[-_](?:banner|notices?|popup|modal|masthead|related|share|social|newsletter|widget|toolbar|pagination|login|search)",
    re.I,
)
SHUT_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption summary".split())
NO_CONTAINER = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
YES, MAY, NO = 2, 1, 0  # how surely an element is something else than content


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, inside) of each piece of markup, in order; the name of an end tag starts with a slash, that of comments and the like is empty, raw elements are one piece."""
    at, loose, raw_end = page.find("<"), False, {}
    while at >= 0:
        end, name, inside = -1, "", ""
        if page.startswith(("<!--", "<![CDATA["), at):
            close = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(close, at + 4)
            end = len(page) if end < 0 else end + len(close)
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or len(page)
        elif m := NAME.match(page, at + 1):
            # once a tag has been found to have no end by its quotes, the next sign ends a tag
            rest = (LOOSE if loose else REST).match(page, m.end())
            if rest is None and not loose:
                loose = True
                rest = LOOSE.match(page, m.end())
            if rest is not None:
                end, name, inside = rest.end(), m[0].lower(), page[m.end() : rest.end()]
                if name in RAW and not inside.endswith("/>"):
                    if name not in raw_end:
                        raw_end[name] = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I)
                    close_ = raw_end[name].search(page, end)
                    end = close_.end() if close_ else len(page)
        if end > 0:
            yield at, end, name, inside
        at = page.find("<", max(end, at + 1))


def _judged(name: str, inside: str) -> int:
    """How surely a start tag opens something else than content."""
    if name in OTHER:
        return YES
    found = MAY if name in MAYBE else NO
    if name not in ("html", "body", "main") and "=" in inside:
        for _, *values in NAMED.findall(inside):
            for word in "".join(values).split():
                if name == "article":
                    found = YES if COMMENT_NAMES.fullmatch(word) else found
                elif OTHER_NAMES.fullmatch(word):
                    return YES
                elif MAYBE_NAMES.fullmatch(word):
                    found = MAY
    return found


class Page:
    """The elements of a page in page order, and its text blocks, each with the element that it stands in.

    tag, parent, path, other: of each element; last: the number after those within it; an
    element 0 is around all. Paths are numbers, equal for elements with equal tags from the root.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.other, self.last = [""], [-1], [0], [NO], [0]
        self.blocks: list[tuple[int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack, self._blocks_at, self._open = [0], [0], {}
        self._run: list[str] = []
        self._where = 0
        at = 0
        for start, end, name, inside in tags(page):
            self._say(page[at:start])
            at = end
            if not name or name in RAW:
                if name and name not in ("script", "style"):
                    self._flush()
            elif name[0] == "/":
                self._end(name[1:])
            else:
                self._start(name, inside)
        self._say(page[at:])
        self._flush()
        self._shut(0)

    def _say(self, raw: str) -> None:
        if raw:
            if not self._run:
                self._where = self._stack[-1]
            self._run.append(raw)

    def _flush(self) -> None:
        if self._run:
            # references are decoded piece by piece, so that tags don't make new ones
            text = " ".join("".join(map(html.unescape, self._run)).split())
            self._run = []
            if text:
                self.blocks.append((self._where, text))

    def _shut(self, depth: int) -> None:
        """Close the open elements from this depth on."""
        n = len(self.tag)
        while len(self._stack) > depth:
            element = self._stack.pop()
            self.last[element] = n
            at = len(self._stack)
            if self._blocks_at and self._blocks_at[-1] == at:
                self._blocks_at.pop()
            if element:
                self._open[self.tag[element]].pop()

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        depths = self._open.get(name)
        # an inline end tag doesn't close blocks
        if depths and (name not in INLINE or depths[-1] > self._blocks_at[-1]):
            self._shut(depths[-1])

    def _start(self, name: str, inside: str) -> None:
        if name not in INLINE:
            self._flush()
        if name in VOID:
            return
        shut = SHUT_BY.get(name, frozenset())
        if name in BLOCKS_P:
            shut = {*shut, "p"}
        if shut:
            # the innermost block, or a paragraph around it, unless another block is between
            k = len(self._blocks_at) - 1
            while k and "p" not in shut and self.tag[self._stack[self._blocks_at[k]]] == "p":
                k -= 1
            inner = self._blocks_at[k]
            if inner and self.tag[self._stack[inner]] in shut:
                self._shut(inner)
        if inside.endswith("/>"):
            return
        above = self._stack[-1]
        key = (self.path[above], name)
        self.tag.append(name)
        self.parent.append(above)
        self.path.append(self._paths.setdefault(key, len(self._paths) + 1))
        self.other.append(_judged(name, inside))
        self.last.append(0)
        depth = len(self._stack)
        self._stack.append(len(self.tag) - 1)
        self._open.setdefault(name, []).append(depth)
        if name not in INLINE:
            self._blocks_at.append(depth)


def _left_out(page: Page, most: float = 0.5) -> list[bool]:
    """Whether an element is left out with all in it."""
    n = len(page.tag)
    holds, prose = [False] * n, [0.0] * n
    for element, text in page.blocks:
        # prose is text with punctuation, outside links
        if page.tag[element] != "a":
            prose[element] += len(text) if PUNCTUATION.search(text) else 0
    sure = [False] * n
    for i in range(1, n):
        sure[i] = sure[page.parent[i]] or page.other[i] == YES
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        holds[up] |= holds[i] or (page.tag[i] in ("article", "main") and not sure[i])
        if page.other[i] != YES:
            prose[up] += prose[i]
    out = [False] * n
    for i in range(1, n):
        if page.other[i] == YES:
            own = True
        elif page.other[i] == MAY:
            own = not holds[i] and (holds[0] or prose[i] <= most * prose[0])
        else:
            own = False
        out[i] = own or out[page.parent[i]]
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 1, mode="edge"), [0.25, 0.5, 0.25], "valid") if len(x) > 2 else x


def _around(page: Page, best: int, elements: list[int]) -> int:
    """The outermost article around an element, else the innermost main, else itself; then the highest ancestor that adds only content blocks."""
    up, article, main = best, 0, 0
    while up > 0:
        if page.tag[up] == "article":
            article = up
        elif page.tag[up] == "main":
            main = main or up
        up = page.parent[up]
    best = article or main or best
    # blocks before and after what best holds; each is looked at once
    low = int(np.searchsorted(elements, best))
    high = int(np.searchsorted(elements, page.last[best]))
    while best:
        up = page.parent[best]
        first, last = int(np.searchsorted(elements, up)), int(np.searchsorted(elements, page.last[up]))
        for k in [*range(low - 1, first - 1, -1), *range(high, last)]:
            # a block that begins with a link is none
            n = elements[k]
            while page.tag[n] in INLINE and page.tag[n] != "a":
                n = page.parent[n]
            if page.tag[n] not in CONTENT:
                return best
        best, low, high = up, first, last
    return best


def main_text(source: str | None, share: float = 0.1, hold: float = 0.9) -> str:
    """The main text of a page; empty if it has none.

    share: a path witnesses content if its fused ratio is at least so much of the best;
    hold: the content element has at least so much of the witnesses' weight.
    """
    page = Page(source or "")
    out = _left_out(page)
    found = [(n, t) for n, t in page.blocks if not out[n]]
    if not found:
        return ""
    order: dict[int, int] = {}
    for n, _ in found:
        order.setdefault(page.path[n], len(order))
    length, marks, nodes = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order))
    for n, t in found:
        i = order[page.path[n]]
        length[i] += len(t)
        marks[i] += len(PUNCTUATION.findall(t))
        nodes[i] += 1
    text_ratio, mark_ratio = length / nodes, (marks + 1) / nodes
    fused = np.sqrt(_smooth(text_ratio) * text_ratio) * np.sqrt(_smooth(mark_ratio) * mark_ratio) * np.log1p(length)
    witness = fused >= share * fused.max()
    weight = [0.0] * len(page.tag)
    for n, t in found:
        weight[n] += len(t) if witness[order[page.path[n]]] else 0
    depth = [0] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        weight[page.parent[i]] += weight[i]
    best = 0
    for i in range(1, len(page.tag)):
        depth[i] = depth[page.parent[i]] + 1
        if depth[i] > depth[best] and weight[i] >= hold * weight[0] and page.tag[i] not in NO_CONTAINER:
            best = i
    # blocks come in the order of their elements' starts, but for text behind a closed element
    best = _around(page, best, sorted({n for n, _ in found}))
    return " ".join(t for n, t in found if best <= n < page.last[best])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars) for every row of pages; a null or empty page has an empty text. Pages are read whole, one at a time; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = whole_texts(source).mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
