"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of tags from the root to it.
Over all nodes with one path the text length and the punctuation are added up:
a path's text ratio is its mean text length, its punctuation ratio its mean
number of marks.  Both, laid out in page order, are smoothed with a Gaussian and
fused as a product; the mean over a path's nodes is the path's ratio, and paths
above a share of the standard deviation are content.

What the thresholded paths select: the *core* is the smallest element with
nearly all of the content's weight (length times ratio).  Of its blocks those
stay that hold content, and headings and short ones beside them, but not blocks
without content that are mostly links.  Outside of the core those
stay whose ratio comes near the core's, and of the core's brothers (and its
ancestors') paragraphs with content.  A heading goes with the text after it.

Never main text, by their tags: navigation, page headers (the headings of an
article's own header stay), footers, asides, forms with their controls, menus,
dialogs, and what isn't displayed.  Captions, labels and field sets outside of
forms are text as any other.  Words of a role, class or id (advert, sidebar,
comment, ...) take out an element beside the core, never one around it, and no
heading or paragraph of an article.

Pages are independent, so extraction runs in the scan's stage: no shuffle.  Time
and memory are linear in a page's length, however deep its elements nest.  A
text inside a block is trimmed and its white space becomes one space; blocks are
joined by one line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrasample.llm._session import ship

#: Fixed sets of HTML tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas video audio textarea select option title".split())
NEVER = frozenset("nav header footer aside form button menu dialog head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = re.compile("h[1-6]$")
CLOSED_BY: dict[str, frozenset[str]] = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"])
}
CLOSED_BY |= {f"h{n}": BLOCKS for n in range(1, 7)}
#: A list, table, quotation or listing is a part of an article, not the whole.
PARTS = frozenset("blockquote dd dl dt li ol p pre table tbody td tfoot th thead tr ul h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark an element as none of the main text.
NOISE = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sponsors nav navbar navigation menu menubar
    breadcrumb breadcrumbs header masthead topbar toolbar footer foot bottombar sidebar aside widget widgets rail related recommended recommendations
    share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup
    login register search comment comments reply replies respond discussion disqus reader responses pagination pager paging skip copyright legal disclaimer tags taglist
    hidden print contentinfo complementary alertdialog form""".split()
)
#: Of these, words of text by others, which may be longer than the main text.
OTHERS = frozenset("comment comments related recommended recommendations reply replies respond responses discussion disqus".split())
#: And of these, words of reader comments, which are no part of the main text however long they are.
READERS = frozenset("comment comments reply replies respond responses discussion disqus".split())
#: Content outside of the core needs this share of the core's own ratio, unless it is a paragraph right beside it: a sentence elsewhere isn't part of the article.
BESIDE_SHARE = 0.5
#: An attribute word of these keeps an element even if a noise word stands beside it.
CONTENT = frozenset("article content main post story entry body text".split())

_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|$)|(?P<other>[!?][^>]*(?:>|$))|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?P<end>>|$))",
    re.S
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"[.,;:!?…。，、；：！？]")


def _noise(tag: str, attrs: str, article: bool = False) -> tuple[bool, set[str]]:
    """Whether the element is none of the main text by its tag or is hidden, and its words that say so.

    Headings, paragraphs, list items and the like have ids made of their own text: only their classes
    and roles count, and within an article not these either.
    """
    words: set[str] = set()
    if tag in NEVER:
        return True, words
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", value
        ):
            return True, words
        if name in ("class", "id", "role") and not (tag in PARTS and (article or name == "id")):
            found = _WORD.findall(value)
            if not (tag in ("article", "main", "body") or found and found[-1] in CONTENT and found[0] not in NOISE):
                words |= NOISE.intersection(found)
    return False, words


class Page:
    """Text nodes of a page in order, and its elements by number (0 is the page itself).

    Of a node: its text, path, element, block, and whether it is ``noise``, part
    of a link or of a heading.  Of an element: its tag, parent, first node and one
    past its last, and its words that make it doubtful.  ``tags`` has a path's
    parent path and last tag.
    """

    __slots__ = ("block", "close", "element", "heading", "link", "noise", "open", "parent", "path", "tag", "tags", "text", "words")

    def __init__(self, html: str):
        self.text: list[str] = []
        self.path: list[int] = []
        self.element: list[int] = []
        self.block: list[int] = []
        self.noise: list[bool] = []
        self.link: list[bool] = []
        self.heading: list[bool] = []
        self.tag, self.parent, self.open, self.close = [""], [0], [0], [0]
        self.words: dict[int, set[str]] = {}
        self.tags: list[tuple[int, str]] = [(0, "")]
        paths: dict[tuple[int, str], int] = {}
        # of the open elements: tag, element, path, and whether it is in noise, a link, a heading, an article, an article's own header
        stack: list[tuple[str, int, int, bool, bool, bool, bool, bool]] = [("", 0, 0, *(False,) * 5)]
        opened: dict[str, int] = {}  # how many elements of a tag are open
        marks: list[int] = []  # places in the stack of blocks and of what blocks close
        block, at, size = 0, 0, len(html)

        def add(raw: str) -> None:
            if raw:
                _, e, path, noise, link, heading, _, own = stack[-1]
                self.text.append(unescape(raw))
                self.path.append(path), self.element.append(e), self.block.append(block)
                self.noise.append(noise or own and not heading), self.link.append(link), self.heading.append(heading)

        def pop(length: int) -> None:
            while len(stack) > length:
                name, e, *_ = stack.pop()
                opened[name] -= 1
                self.close[e] = len(self.text)
            while marks and marks[-1] >= length:
                marks.pop()

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                add(html[at:])
                break
            m = _TAG.match(html, lt)
            if not m:  # a bare <
                add(html[at : lt + 1])
                at = lt + 1
                continue
            add(html[at:lt])
            at = m.end()
            name = m["name"]
            if not name:
                continue
            tag = name.lower()
            if m["end"] == "" and at >= size:  # the page was cut inside a tag
                break
            if m["close"]:
                if opened.get(tag):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    pop(k)
                if tag in BLOCKS:
                    block += 1
                continue
            if tag == "br":
                add(" ")
            if tag in BLOCKS:
                block += 1
                while marks and tag in CLOSED_BY.get(stack[marks[-1]][0], ()):  # an unclosed paragraph or list item ends here
                    pop(marks[-1])
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
                continue
            _, above, path, noise, link, heading, article, own = stack[-1]
            e = len(self.tag)
            never, words = _noise(tag, m["attrs"], article)
            if words:
                self.words[e] = words
            if (path, tag) not in paths:
                paths[path, tag] = len(self.tags)
                self.tags.append((path, tag))
            if tag == "header" and article:
                never, own = False, True
            heading = heading or bool(HEADING.match(tag))
            self.tag.append(tag), self.parent.append(above), self.open.append(len(self.text)), self.close.append(0)
            if tag in CLOSED_BY or tag in BLOCKS:
                marks.append(len(stack))
            opened[tag] = opened.get(tag, 0) + 1
            stack.append(
                (tag, e, paths[path, tag], noise or never, link or tag == "a" and not heading, heading, article or tag in ("article", "main"), own)
            )
        pop(1)
        self.close[0] = len(self.text)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The sum of ``value`` over every element's nodes (they follow each other, so by sums up to a place)."""
        upto = np.append(0.0, np.cumsum(value))
        return upto[np.array(self.close)] - upto[np.array(self.open)]

    def within(self, elements: np.ndarray) -> np.ndarray:
        """Which nodes lie in any of some elements."""
        edge = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(edge, np.array(self.open)[elements], 1)
        np.add.at(edge, np.array(self.close)[elements], -1)
        return np.cumsum(edge[:-1]) > 0


def fused_ratios(page: Page, sigma: float) -> np.ndarray:
    """One smoothed and fused ratio for each text node, the same for all nodes of a path."""
    path = np.array(page.path)
    clean = [_SPACE.sub(" ", t).strip() for t in page.text]
    length = np.array([len(t) for t in clean], float)
    marks = np.array([len(_MARK.findall(t)) for t in clean], float)
    some = np.maximum(np.bincount(path, length > 0), 1)
    text_ratio, mark_ratio = np.bincount(path, length) / some, np.bincount(path, marks) / some
    # nodes of blanks only don't stand between the others
    seen = np.flatnonzero(length > 0)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * np.square(np.arange(-reach, reach + 1) / sigma))
    weight = np.convolve(np.ones(len(seen)), kernel, "full")[reach : reach + len(seen)]
    smooth = lambda x: np.convolve(x, kernel, "full")[reach : reach + len(seen)] / weight
    fused = np.zeros(len(path))
    if len(seen):
        fused[seen] = smooth(text_ratio[path[seen]]) * (1 + smooth(mark_ratio[path[seen]]))
    return np.bincount(path, fused)[path] / some[path]


def _named(page: Page, weight: np.ndarray) -> np.ndarray:
    """Which nodes lie in elements that are none of the main text by their words.

    An element around the article with the most weight, or with most of the
    weight (nearly all, if the words are those of text by others), is a wrapper of
    the main text and taken out by its words in no case; reader comments are no
    wrapper by their weight.
    """
    none = np.zeros(len(page.text), bool)
    if not page.words or not weight.any():
        return none
    named = np.array(sorted(page.words))
    others = np.array([bool(page.words[e] & OTHERS) for e in named.tolist()])
    held = page.sums(weight)
    whole = [e for e, t in enumerate(page.tag) if t in ("article", "main")]
    wrapper = np.zeros(len(page.tag), bool)
    e = max(whole, key=lambda x: (held[x], x), default=0)
    inner = none | True
    if e and held[e] > 0:
        inner = page.within(np.array([e]))
        while e:
            wrapper[e] = True
            e = page.parent[e]
    out = none
    readers = np.array([bool(page.words[e] & READERS) for e in named.tolist()])
    for some, most in ((named[readers], None), (named[others & ~readers], 0.9), (named[~others], 0.5)):
        left = weight * (inner & ~out)
        share = page.sums(left)
        if most is not None:
            wrapper[some[share[some] > most * left.sum()]] = True
        out = out | page.within(some[~wrapper[some]])
    return out if (weight * ~out).any() else none


def _core(page: Page, weight: np.ndarray, share: float) -> int:
    """The smallest element with more than ``share`` of the weight; no part of an article (a list, a table), but the article itself."""
    held = page.sums(weight)
    e = int(np.flatnonzero(held >= share * weight.sum() - 1e-9).max())  # they contain each other
    while e and (page.tag[e] in PARTS or page.tag[e] not in BLOCKS):
        e = page.parent[e]
    up = e
    while up:
        if page.tag[up] == "article":
            return up
        up = page.parent[up]
    return e


def _brothers(page: Page, core: int) -> np.ndarray:
    """Which nodes are in a paragraph, heading, list item or cell whose parent is around the core."""
    spine = np.zeros(len(page.tag), bool)
    spine[0] = True
    e = page.parent[core]
    while e:
        spine[e] = True
        e = page.parent[e]
    near = np.zeros(len(page.tag), bool)
    for e in range(1, len(page.tag)):
        above = page.parent[e]
        near[e] = spine[above] and page.tag[e] in PARTS if page.tag[e] in BLOCKS else near[above]
    return near[np.array(page.element)]


def selected(page: Page, ratio: np.ndarray, threshold: float = 0.5, share: float = 0.9) -> np.ndarray:
    """Which text nodes are main text, by the ratios of their paths."""
    length = np.array([len(t.strip()) for t in page.text], float) * ~np.array(page.noise, bool)
    seen = length > 0
    if not seen.any():
        return seen
    limit = threshold * ratio[seen].std()
    content = seen & (ratio >= limit)
    content = content if content.any() else seen
    out = _named(page, length * ratio * content)
    length, content = length * ~out, content & ~out
    clean = length > 0
    content = content if content.any() else clean
    core = _core(page, length * ratio * content, share)
    inside = page.within(np.array([core])) if core else np.ones(len(page.text), bool)
    link = length * np.array(page.link, bool)
    # inside the core: without blocks that hold no content and mostly links
    text_of, link_of, content_of = page.sums(length), page.sums(link), page.sums(content.astype(float))
    block_tag = np.array([t in BLOCKS for t in page.tag])
    lists = np.flatnonzero(block_tag & (content_of == 0) & (link_of > 0.5 * text_of))
    keep = inside & ~page.within(lists)
    # outside: whole blocks with content that aren't mostly links, and headings
    block, within = np.array(page.block), length * content * inside
    brother = _brothers(page, core)
    equal = content & (brother | (ratio >= BESIDE_SHARE * (within @ ratio) / within.sum()))
    text_in, link_in, content_in = (np.bincount(block, x) for x in (length, link, equal.astype(float)))
    beside = (content_in > 0) & (link_in <= 0.5 * text_in)
    keep = (keep | ~inside & beside[block]) & clean
    # a heading goes with the text that follows it
    follows = False
    for i in np.flatnonzero(clean)[::-1].tolist():
        if page.heading[i] and follows:
            keep[i] = True
        follows = bool(keep[i])
    # blanks between the words of kept blocks
    kept = np.bincount(block, keep) > 0
    blank = np.array([not t.strip() for t in page.text])
    return keep | blank & kept[block] & ~np.array(page.noise, bool)


def main_text(html: str | None, *, sigma: float = 1.0, threshold: float = 0.5, share: float = 0.9) -> str:
    """The main text of one page; empty where there is none."""
    if not html:
        return ""
    page = Page(html)
    if not page.text:
        return ""
    blocks: dict[int, list[str]] = {}
    for i in np.flatnonzero(selected(page, fused_ratios(page, sigma), threshold, share)).tolist():
        blocks.setdefault(page.block[i], []).append(page.text[i])
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep_columns: bool = False) -> DataFrame:
    """page_id, url (or all columns but the html), text and n_chars of every row of ``pages``.

    Null or empty html, or a page without any main text: empty text, 0.  A page
    cut off anywhere gives what stands before the cut.  Repeated rows give a row
    each.  Very long and deeply nested pages take time and memory in proportion to
    their length.  Columns named text or n_chars are replaced.
    """
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)] if keep_columns else [id_col, url_col]
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                texts = [main_text(h) for h in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*kept, "text", "n_chars"]
                )

    source = pages.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{html_col}`"]))
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "text string", "n_chars bigint"]))
