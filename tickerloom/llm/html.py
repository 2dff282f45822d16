"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements; inline elements and their text belong to the block around
them. The trees see each node's own and subtree text, the density of links and tags in it, depth,
place among its siblings, and the words of its tag, class and id. Hierarchical decoding picks the
set of nodes with the largest total of log-odds in which a node is kept only below kept nodes, so
that no node contradicts its ancestors.

No page carries labels. The trees learn from parts that state their own role: article and main
elements are content, navigation, headers, footers, asides, forms and blocks whose class or id
says so are not. Each training node is used as it is and again with groups of its inputs hidden,
above all the words of its tag, class and id, so that no single group decides and pages that say
nothing about themselves are read by densities and places. The trees are fitted on at most TRAIN_PAGES pages (those with the smallest hashes); all pages are decoded.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, whole_text, workers_import

TRAIN_PAGES = 400
#: Most training nodes of one page; like TRAIN_PAGES it bounds the fitting alone.
PAGE_NODES = 400
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math".split())
_BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset "
    "address details summary head title script style noscript template textarea iframe svg math "
    "select button dialog menu search".split()
)
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th", "tbody"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements that an unclosed element inside them does not reach out of.
_WALLS = frozenset("html body article section main div ul ol dl table td th header footer nav aside".split())
_NO_P = _BLOCK - {"html", "body", "head", "title", "script", "style", "noscript", "template", "button", "select"}

_TAG_NAME = re.compile(r"</?+([A-Za-z][^\s/<>\"']*+)")
#: The attributes of a tag and its end; a quoted value may hold any character.
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
#: Characters in which the end of a tag is looked for before the ends of the whole page are laid out.
_NEAR = 256
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

#: Tags and attribute words that state a role.
_DROP_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg math head title select button "
    "textarea dialog menu search fieldset".split()
)
_KEEP_TAGS = frozenset(("article", "main"))
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs footer sidebar aside widget related recommended "
    "comment comments disqus reply replies cookie cookies consent gdpr notice popup modal overlay "
    "share sharing social subscribe newsletter signup login search form masthead toolbar pagination "
    "pager copyright legal skip".split()
)
_KEEP_WORDS = frozenset("article content main post story entry body text articlebody".split())


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset[str]
    order: int = 0
    siblings: int = 0
    texts: list = field(default_factory=list)
    links: int = 0
    marks: int = 0
    children: list = field(default_factory=list)
    total: int = 0
    total_links: int = 0
    total_marks: int = 0
    nodes: int = 1
    at: int = 0


class _TagEnds:
    """The place after the tag whose attributes start at a given place, -1 where it never ends.

    A mark's answer follows from marks to its right, so one backward pass settles all of them.
    """

    def __init__(self, page: str) -> None:
        self.marks = array("q", (m.start() for m in _MARK.finditer(page)))
        count = len(self.marks)
        self.ends = array("q", [-1]) * (count + 1)
        following = {'"': count, "'": count}
        for i in range(count - 1, -1, -1):
            mark = page[self.marks[i]]
            if mark == ">":
                self.ends[i] = self.marks[i] + 1
                continue
            closing = following[mark]
            self.ends[i] = self.ends[closing + 1] if closing < count else -1
            following[mark] = i

    def after(self, place: int) -> int:
        return self.ends[bisect_left(self.marks, place)]


def _tokens(page: str) -> Iterator[tuple[int, str, str | None, str]]:
    """(end, text, tag, attributes) from left to right; the tag is None for text.

    Takes back the place it is sent, if it is sent one. Every character is looked at a bounded
    number of times, whatever is left open: a `<` that begins nothing which ends is text.
    """
    at, size = 0, len(page)
    ends: _TagEnds | None = None
    closable = True
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            at = (yield end, page[at:end], None, "") or end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        name = _TAG_NAME.match(page, at)
        if name or page.startswith(("<!", "<?"), at):
            start = name.end() if name else at + 2
            near = _REST.match(page, start, start + _NEAR) if name and not ends else None
            if near:
                end = near.end()
            elif name:
                ends = ends or _TagEnds(page)
                end = ends.after(start)
            else:
                end = page.find(">", start) + 1 if closable else 0
                closable = end > 0  # where none follows, none follows any later place
                end = end or -1
            if end >= 0:
                if name:
                    closes = page[at + 1] == "/"
                    at = (yield end, "/" if closes else "", name[1].lower(), page[start : end - 1]) or end
                else:
                    at = end
                continue
        at = (yield at + 1, "<", None, "") or at + 1


class _Open:
    """The open elements, each with its block, and where elements of a tag and walls lie among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("root", 0)]
        self.places: dict[str, list[int]] = {}
        self.walls = [0]
        self.links = 0

    @property
    def block(self) -> int:
        return self.stack[-1][1]

    def push(self, tag: str, block: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _WALLS:
            self.walls.append(len(self.stack))
        self.links += tag == "a"
        self.stack.append((tag, block))

    def cut(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in _WALLS:
                self.walls.pop()
            self.links -= tag == "a"

    def end(self, tag: str) -> bool:
        """Closes the innermost element of the tag; whether there is one."""
        places = self.places.get(tag)
        if places:
            self.cut(places[-1])
            return True
        return False

    def close(self, tags: set[str]) -> None:
        """Closes the innermost element of the tags if no wall lies in it."""
        place = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if place and place >= self.walls[-1]:
            self.cut(place)


def parse(page: str) -> list[Node]:
    """The block elements of a page in page order, parents before children; 0 is the root.

    Tolerates missing and stray end tags, unquoted attributes and cut-off pages. A text chunk is
    kept in the block that holds it, with a break (None) where a child block stands between.
    """
    nodes = [Node("root", -1, 0, frozenset())]
    opened = _Open()
    size = len(page)
    tokens = _tokens(page)
    skip = None  # where to go on after an element whose content is not markup
    while True:
        try:
            end, text, tag, attributes = tokens.send(skip)
        except StopIteration:
            break
        skip = None
        if tag is None:
            node = nodes[opened.block]
            node.texts.append(text)
            if opened.links:
                node.links += len(text)
            continue
        if text == "/":
            opened.end(tag)
            continue
        if tag == "p" or tag in _NO_P:
            opened.close({"p"})
        if tag in _CLOSES:
            opened.close(_CLOSES[tag])
        block = opened.block
        nodes[block].marks += 1
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            if tag in ("br", "hr", "wbr"):
                nodes[block].texts.append("" if tag == "wbr" else "\n")
            continue
        if tag in _BLOCK:
            words = set()
            for kind, *values in _ATTRIBUTE.findall(attributes):
                words.update(_WORDS.findall(next(filter(None, values), "").lower()))
            parent = nodes[block]
            parent.texts.append(None)
            nodes.append(
                Node(tag, block, parent.depth + 1, frozenset(words), order=len(parent.children), at=end)
            )
            parent.children.append(len(nodes) - 1)
            block = len(nodes) - 1
        if tag in _RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, end)
            if tag in ("title", "textarea"):
                nodes[block].texts.append(page[end : closing.start() if closing else size])
            skip = closing.end() if closing else size
            continue
        opened.push(tag, block)
    for node in nodes:
        node.siblings = len(nodes[node.parent].children) if node.parent >= 0 else 1
        own = sum(len(t) for t in node.texts if t)
        node.total, node.total_links, node.total_marks = own, node.links, node.marks
    for i in range(len(nodes) - 1, 0, -1):
        node, parent = nodes[i], nodes[nodes[i].parent]
        parent.total += node.total
        parent.total_links += node.total_links
        parent.total_marks += node.total_marks
        parent.nodes += node.nodes
    return nodes


_TAG_GROUPS = ("p", "h1", "h2", "h3", "li", "td", "div", "section", "article", "main", "header")
FEATURES = 19 + len(_TAG_GROUPS) + 4
#: Groups of inputs: own text, subtree, place, words.
_GROUPS = (range(0, 6), range(6, 11), range(11, 19), range(19, FEATURES))
#: Groups hidden in the further uses of a training node, and what stands for a hidden input.
_HIDE = ((3,), (2,), (2, 3), (1, 2), (0, 1, 2))
_HIDDEN = -1


def features(nodes: list[Node], size: int) -> np.ndarray:
    """One row per node: densities, depth, place among siblings, words of tag, class and id."""
    out = np.zeros((len(nodes), FEATURES), dtype=np.float32)
    for i, node in enumerate(nodes):
        own = "".join(t for t in node.texts if t).strip()
        parent = nodes[node.parent] if node.parent >= 0 else node
        words = own.count(" ") + 1 if own else 0
        total = max(1, node.total)
        row = [
            len(own),
            words,
            len(own) / max(1, words),
            sum(own.count(c) for c in ".!?") / max(1, words),
            own.count(",") / max(1, words),
            node.links / max(1, len(own)),
            node.total,
            node.total_links / total,
            node.total_marks / total * 100,
            node.total / node.nodes,
            node.nodes,
            node.depth,
            node.order,
            node.siblings,
            node.order / max(1, node.siblings),
            node.at / max(1, size),
            node.total / max(1, parent.total),
            parent.total,
            parent.total_links / max(1, parent.total),
            *(node.tag == t for t in _TAG_GROUPS),
            node.tag in _DROP_TAGS,
            len(node.words & _DROP_WORDS),
            len(node.words & _KEEP_WORDS),
            parent.tag in _KEEP_TAGS,
        ]
        out[i] = row
    return out


def stated_roles(nodes: list[Node]) -> np.ndarray:
    """1 for content, 0 for anything else, -1 where nothing in or above the node says."""
    role = np.full(len(nodes), -1)
    for i, node in enumerate(nodes):
        above = role[node.parent] if node.parent >= 0 else -1
        if above == 0 or node.tag in _DROP_TAGS or node.words & _DROP_WORDS:
            role[i] = 0
        elif node.tag == "header" and above != 1:
            role[i] = 0
        else:
            role[i] = 1 if above == 1 or node.tag in _KEEP_TAGS else -1
    # A node that only holds others has the role of most of the text in it.
    good, known = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        own = sum(len(t) for t in nodes[i].texts if t)
        good[i] += own * (role[i] == 1)
        known[i] += own * (role[i] >= 0)
        good[nodes[i].parent] += good[i]
        known[nodes[i].parent] += known[i]
    holds = (role < 0) & (known > 0)
    role[holds] = good[holds] * 2 >= known[holds]
    return role


@dataclass
class Trees:
    """Boosted trees of equal depth, as arrays by tree and node; leaves are log-odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the logistic loss, split on histograms of BINS quantiles."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature = np.zeros((TREES, inner), dtype=np.int64)
    cut = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, leaves))
    trees = Trees(base, feature, cut, leaf)
    if not len(y) or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    odds = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        slope, bend = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            chosen = [(0, np.inf, BINS)] * width
            for f in range(x.shape[1]):
                slot = (at - first) * BINS + binned[:, f]
                g = np.bincount(slot, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(slot, bend, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + 1) + gr**2 / (hr + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain = gain[:, : len(edges[f])]
                if not gain.size:
                    continue
                k = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[n], chosen[n] = gain[n, k[n]], (f, edges[f][k[n]], k[n])
            for n, (f, c, _) in enumerate(chosen):
                feature[t, first + n], cut[t, first + n] = f, c
            f, b = (np.array([c[j] for c in chosen])[at - first] for j in (0, 2))
            at = 2 * at + 1 + (binned[np.arange(len(y)), f] > b)
        at -= inner
        leaf[t] = RATE * np.bincount(at, slope, leaves) / (np.bincount(at, bend, leaves) + 1)
        odds += leaf[t][at]
    return trees


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best total in which each kept node has a kept parent."""
    gain = log_odds * np.log1p([n.total for n in nodes])
    for i in range(len(nodes) - 1, 0, -1):
        gain[nodes[i].parent] += max(0.0, gain[i])
    kept = np.zeros(len(nodes), dtype=bool)
    for i, node in enumerate(nodes):
        kept[i] = node.parent < 0 or kept[node.parent] and gain[i] > 0
    return kept


def main_text(page: str, nodes: list[Node], kept: np.ndarray) -> str:
    """The kept blocks in page order; white space in a block is one space, blocks two line ends."""
    # A block's own text is cut where child blocks stand, so it takes its turn between them.
    out: list[str] = []
    open_nodes = [(0, iter(nodes[0].texts), iter(nodes[0].children))]
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    while open_nodes:
        _, texts, children = open_nodes[-1]
        for text in texts:
            if text is not None:
                run.append(text)
                continue
            flush()
            child = next(children)
            if kept[child]:
                open_nodes.append((child, iter(nodes[child].texts), iter(nodes[child].children)))
                break
        else:
            flush()
            open_nodes.pop()
    return "\n\n".join(out)


def learn(pages: DataFrame, most: int = TRAIN_PAGES, page_nodes: int = PAGE_NODES) -> Trees:
    """Fits on at most `most` different pages, which state the roles of some of their parts.

    The pages are chosen by hashes alone; only what is learnt from the chosen ones leaves their
    tasks, so that whole pages never meet. Of a page at most `page_nodes` nodes are used, evenly spread.
    """
    check_columns(pages, ("url", "html"))
    workers_import(pages.sparkSession)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, sign, page in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                nodes = parse(page)
                role, x = stated_roles(nodes), features(nodes, len(page))
                at = np.flatnonzero(role >= 0)
                if len(at) > page_nodes:
                    at = at[np.linspace(0, len(at) - 1, page_nodes).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([place], pa.int64()),
                        pa.array([sign], pa.int64()),
                        pa.array([x[at].tobytes()], pa.binary()),
                        pa.array([role[at].astype(np.int8).tobytes()], pa.binary()),
                    ],
                    names=["place", "sign", "x", "y"],
                )

    signed = pages.where("html is not null").select(
        F.xxhash64("url").alias("place"), F.xxhash64("html").alias("sign"), F.col("html").cast("string")
    )
    chosen = signed.select("place", "sign").distinct().orderBy("place", "sign").limit(most)
    learnt = (
        signed.join(F.broadcast(chosen), ["place", "sign"], "left_semi")  # `most` rows of two numbers
        .mapInArrow(prepare, "place long, sign long, x binary, y binary")
        .groupBy("place", "sign")  # copies of a page count once
        .agg(F.min("x").alias("x"), F.min("y").alias("y"))
    )
    rows = sorted(learnt.select("x", "y").collect())
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(-1, FEATURES)
    y = np.frombuffer(b"".join(r["y"] for r in rows), dtype=np.int8).astype(np.float64)
    uses = [x]
    for hide in _HIDE:
        uses.append(x.copy())
        uses[-1][:, [i for g in hide for i in _GROUPS[g]]] = _HIDDEN
    return fit(np.concatenate(uses), np.tile(y, len(uses)))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages.

    Null or empty html, and pages without content, give an empty text. Rows are independent, so
    repeated rows give repeated results; other columns are ignored.
    """
    check_columns(pages, ("page_id", "url", "html"))
    workers_import(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                html = part.column(2).to_pylist()
                parsed = [parse(page) for page in html]
                x = [features(nodes, len(page)) for nodes, page in zip(parsed, html, strict=True)]
                odds = trees.log_odds(np.concatenate(x))
                bounds = np.cumsum([0, *map(len, parsed)])
                texts = [
                    main_text(page, nodes, decode(nodes, odds[a:b]))
                    for page, nodes, a, b in zip(html, parsed, bounds[:-1], bounds[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html"))
    return source.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
