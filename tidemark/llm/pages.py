"""Main text of web pages by tag-path ratios.

Text nodes of a page are grouped by their path of tags and classes from the root. A path's ratios are the characters and
the punctuation of its nodes, smoothed over neighbouring nodes in page order; they are fused into one score on a bounded
scale. Elements that by tag, role or name hold menus, notices or comments weaken the scores of the paths through them,
and so do links. Paths whose score is at least half of what half of the page's text reaches hold content. The region is
the smallest element with most of the content, weighed by how far its paths are above that threshold; it gives its
content paths and the blocks among them (headings, list items, short lines) that no weakening element holds.

All steps are linear in the page: paths are interned, open elements are kept in a stack per name, and sums over subtrees
are taken from the last element back to the first.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import strings

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html dd dt li tbody td tfoot th thead tr".split())
#: Tags that end an open element of the same kind, up to the container that stops them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements without text to read.
SILENT_TAGS = frozenset("head script style noscript template iframe svg canvas object audio video select datalist".split())
#: What weakens the paths through an element, by its tag, role, or the head word of a class or id.
WEAK_TAGS = frozenset("nav aside footer form button label fieldset dialog menu option".split())
WEAK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
WEAK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promotion "
    "promoted recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words of a name that say nothing of what it holds, and those that say that it holds none.
PLAIN_NAMES = frozenset("area articles bar block body box buttons container content form inner item items links list outer panel posts row section slot stories text unit wrap wrapper".split())
WITHOUT = frozenset("has no non not with without".split())
WEAKER, LINKED, STATED = 0.3, 0.5, 1.5
MOST = 0.9

_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_P_STOPS = frozenset("table td th article main section div li aside blockquote button body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def weakens(mark: str) -> bool:
    """Whether a class or id names a part beside the article, by its head word: ``site-menu``, ``ad-box``, not ``no-sidebar`` or ``social-history``."""
    words = _NAME.findall(mark)
    if not WITHOUT.isdisjoint(words):
        return False
    while words and words[-1] in PLAIN_NAMES:
        words.pop()
    return bool(words) and words[-1] in WEAK_NAMES


class _Element:
    __slots__ = ("name", "parent", "depth", "order", "last", "path", "factor", "weak", "silent", "inside_article")

    def __init__(self, name: str, attributes: str, parent: _Element | None, order: int, paths: dict[tuple[int, str], int]) -> None:
        found = {k.lower(): unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        self.name, self.parent, self.order, self.last = name, parent, order, order
        self.depth = parent.depth + 1 if parent else 0
        classes = found.get("class", "").split()
        self.path = paths.setdefault((parent.path if parent else -1, ".".join([name, *sorted(classes)])), len(paths))
        article = name in ("article", "main")
        self.inside_article = article or bool(parent and parent.inside_article)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", ""))
        self.silent = bool(name in SILENT_TAGS or hidden or parent and parent.silent)
        marks = [] if article or name in ("html", "body") else [*classes, *found.get("id", "").split()]
        heads = self.inside_article or any(not {"article", "content", "entry", "post", "story"}.isdisjoint(_NAME.findall(m)) for m in marks)
        self.weak = name in WEAK_TAGS or found.get("role", "") in WEAK_ROLES or name == "header" and not heads
        self.weak = self.weak or any(weakens(m) and not (heads and _NAME.findall(m)[-1] == "header") for m in marks)
        own = WEAKER if self.weak else LINKED if name == "a" else STATED if article and not (parent and parent.inside_article) else 1.0
        self.factor = max(own * (parent.factor if parent else 1.0), 1e-6)


class _Page:
    """The elements of a page in order, and its text nodes as (element, text, block)."""

    def __init__(self, html: str) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.root = self.here = _Element("html", "", None, 0, self.paths)
        self.elements = [self.root]
        self.open: dict[str, list[_Element]] = defaultdict(list)
        self.nodes: list[tuple[_Element, str, int]] = []
        self.block = 0
        self._read(html)
        for e in reversed(self.elements):
            if e.parent:
                e.parent.last = max(e.parent.last, e.last)

    def _text(self, piece: str) -> None:
        if piece and not self.here.silent:
            self.nodes.append((self.here, unescape(piece), self.block))

    def _nearest(self, names: frozenset[str] | set[str]) -> _Element:
        return max((s[-1] for n in names if (s := self.open.get(n))), key=lambda e: e.depth, default=self.root)

    def _close(self, target: _Element) -> None:
        while self.here.depth >= target.depth and self.here is not self.root:
            self.open[self.here.name].pop()
            self.here = self.here.parent

    def _end(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        elif stack := self.open.get(name):
            if name in BLOCK or stack[-1].depth > self._nearest({"table", "article", "main", "body"}).depth:
                self._close(stack[-1])
        self.block += name in BLOCK

    def _start(self, name: str, attributes: str) -> None:
        if name == "html" or name == "body" and self.open.get("body"):
            return
        for names, stops in ([({"p"}, _P_STOPS)] if name in CLOSES_P else []) + ([SIBLINGS[name]] if name in SIBLINGS else []):
            found = self._nearest(names)
            if found is not self.root and found.depth > self._nearest(stops).depth:
                self._close(found)
        if name in _HEADINGS and self.here.name in _HEADINGS:
            self._close(self.here)
        self.block += name in BLOCK
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            if name in ("br", "img"):
                self._text(" ")
            return
        self.here = _Element(name, attributes, self.here, len(self.elements), self.paths)
        self.elements.append(self.here)
        self.open[name].append(self.here)

    def _read(self, html: str) -> None:
        tag, at, size = _TAG, 0, len(html)
        while at < size:
            to = html.find("<", at)
            if to < 0:
                self._text(html[at:])
                return
            self._text(html[at:to])
            if html.startswith("<!--", to):
                end = _COMMENT_END.search(html, to + 2)
                at = end.end() if end else size
                continue
            if html.startswith(("<!", "<?"), to):
                end = html.find("]]>", to) + 2 if html.startswith("<![CDATA[", to) else html.find(">", to)
                at = end + 1 if end > 1 else size
                continue
            m = tag.match(html, to)
            if not m and tag is _TAG and html[to + 1 : to + 2].isalpha():
                tag = _PLAIN_TAG  # a quote that never ends: from here on quotes do not hide the end of a tag
                m = tag.match(html, to)
            if not m:
                if html[to + 1 : to + 2].isalpha() and html.find(">", to) < 0:
                    return  # a tag cut off by the end of the page
                self._text("<")
                at = to + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(html, at)
                at = end.end() if end else size
                if self.here.name == name:
                    self._close(self.here)


def _scores(nodes: list[tuple[_Element, str, int]]) -> np.ndarray:
    """The fused score of each text node, from the ratios of its path."""
    _, path = np.unique([e.path for e, _, _ in nodes], return_inverse=True)
    ratios = np.array([[len(t.strip()), len(_PUNCTUATION.findall(t))] for _, t, _ in nodes], dtype=float)
    count = np.bincount(path)
    mean = np.stack([np.bincount(path, r) / count for r in ratios.T], axis=1)[path]
    if len(nodes) >= 5:
        kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
        mean = np.stack([np.convolve(r, kernel, "same") for r in mean.T], axis=1) / np.convolve(np.ones(len(nodes)), kernel, "same")[:, None]
    # bounded: a path of very long nodes does not put the others out of reach
    fused = np.log1p(mean[:, 0]) * (1 + np.minimum(1, 40 * mean[:, 1] / np.maximum(mean[:, 0], 1)))
    fused *= np.array([e.factor for e, _, _ in nodes])
    return (np.bincount(path, fused) / count)[path]


def _threshold(nodes: list[tuple[_Element, str, int]], scores: np.ndarray) -> float:
    """Half of the score that half of the page's characters reach, those of weak paths counting less."""
    order = np.argsort(scores)
    size = np.cumsum(np.array([len(t.strip()) * e.factor**2 for e, t, _ in nodes])[order])
    return 0.5 * float(scores[order][min(np.searchsorted(size, size[-1] / 2), len(nodes) - 1)])


def _region(page: _Page, nodes: list[tuple[_Element, str, int]], above: np.ndarray) -> _Element:
    """The smallest element with most of the content, or the article that holds half of it."""
    mass = np.zeros(len(page.elements))
    for (element, text, _), a in zip(nodes, above.tolist()):
        mass[element.order] += math.sqrt(max(a, 0.0)) * math.log1p(len(text.strip()))  # so that one long section does not leave out the others
    for e in reversed(page.elements[1:]):
        mass[e.parent.order] += mass[e.order]
    stated = [e for e in page.elements if e.name in ("article", "main") and 0 < mass[0] <= 2 * mass[e.order]]
    region = stated[0] if stated else page.root
    if not stated:
        for e in page.elements[1:]:  # parents come first; one child at most holds as much
            if e.parent is region and mass[0] > 0 and mass[e.order] >= MOST * mass[0] and e.name in BLOCK | {"body"} and e.name not in _HEADINGS | {"p", "li"}:
                region = e
    return region


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, white space inside a block one space, joined by line ends."""
    page = _Page(html or "")
    filled = [n for n in page.nodes if n[1].strip()]
    if not filled:
        return ""
    scores = _scores(filled)
    above = scores - _threshold(filled, scores)
    region = _region(page, filled, above)
    inside = lambda e: region.order <= e.order <= region.last
    content = {n[0].order for n, a in zip(filled, above.tolist()) if a >= 0 and inside(n[0])}
    beside = [False] * len(page.elements)  # whether something in the region weakens the element
    for e in page.elements[region.order + 1 : region.last + 1]:
        beside[e.order] = e.weak or beside[e.parent.order]
    spans = [n[2] for n in filled if n[0].order in content]
    if not spans:
        return ""
    first, last = min(spans), max(spans)
    links, chars = defaultdict(int), defaultdict(int)  # blocks of links before the first or after the last content are menus
    for e, t, b in filled:
        chars[b] += len(t.strip())
        links[b] += len(t.strip()) * (e.factor < (e.parent or e).factor and e.name == "a")
    blocks: dict[int, list[str]] = defaultdict(list)
    for e, t, b in page.nodes:
        if inside(e) and (e.order in content or not beside[e.order]) and (first <= b <= last or 2 * links[b] < chars[b] or not chars[b]):
            blocks[b].append(t)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def _extracted(html: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            rest = [i for i, n in enumerate(batch.schema.names) if n not in (html, out, "n_chars")]
            texts = [main_text(x) for x in strings(batch.column(at))]
            columns = [batch.column(i) for i in rest] + [pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in rest] + [out, "n_chars"])

    return run


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``html`` replaced by its main text in ``out``, and its code points in n_chars.

    A null, empty or textless page gives an empty text; other columns and repeated rows stay, columns named as a new one
    are replaced. Whole pages are read, in time linear in their length; bytes that are not UTF-8 become replacement
    characters. An empty table gives no rows. A quote that never ends hides nothing: its tag ends at the next ``>``.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, out, "n_chars")]
    return pages.mapInArrow(_extracted(html, out), T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]))


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
