"""Operator 3: main text of pages by a tree-structured graphical model on the DOM.

Every block element is a node that is content or not. Its features (text length, link share, punctuation, tag, names of
classes, place) give its potential; each parent and child share one by the kind of child. Messages go up from the leaves
and down from the root, so that a node's marginal takes the whole page into account. The weights are those of the
conditional likelihood's maximum on labelled pages: pages whose authors mark their content with <article> or <main>. The
marks themselves are no features.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import bounded_sample, narrow

#: Labelled pages that train() fits on at most, chosen by hash.
MAX_PAGES = 1500
#: Characters of pages that are parsed and inferred side by side.
AT_ONCE = 2_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a tag closes, up to the nearest of the bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_MARKS = frozenset(("article", "main"))
TAGS = ("p", "div", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "td", "tr", "table", "h1", "h2", "h3", "blockquote", "pre", "body", "section", "other")
_TAG = {t: i for i, t in enumerate(TAGS)} | {"html": TAGS.index("body"), "main": TAGS.index("div"), "article": TAGS.index("div"), "h4": TAGS.index("h3"), "h5": TAGS.index("h3"), "h6": TAGS.index("h3"), "th": TAGS.index("td")}
_GOOD = re.compile(r"article|content|post|story|entry|text|body|main|blog|prose", re.I)
_BAD = re.compile(r"\bad\b|\bads\b|advert|banner|breadcrumb|comment|cookie|footer|foot|header|menu|meta|nav|popup|promo|related|remark|share|sidebar|social|sponsor|subscribe|tags|widget", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PUNCT = re.compile(r"[.,;:!?…。、]")
_SPACE = re.compile(r"\s+")
EDGES = 3


@dataclass
class Page:
    """Nodes in document order; a parent stands before its children."""

    parent: list[int]
    tag: list[int]
    text: list[str]
    link: list[int]
    names: list[int]
    marked: list[bool]
    has_mark: bool


def parse(source: str) -> Page:
    """The tree of block elements, and of runs of text that follow a block inside another; any input gives a tree.

    Inline elements' text belongs to the block around them. Nodes stand in document order, and so do their texts: a block's
    text up to its first inner block is its own, what follows an inner block is a node for itself below it. White space is
    drawn together but for <pre>.
    """
    parent, tag, names, marked, link, verbatim = [-1], [_TAG["body"]], [0], [False], [0], [False]
    parts: list[list[str]] = [[]]
    run = [0]  # by node: the node that takes its text now, -1 after an inner block
    stack: list[tuple[str, int]] = [("html", 0)]
    links = 0
    head = False
    has_mark = False
    at = 0

    def add_node(up: int, kind: int, named: int, mark: bool, pre: bool) -> int:
        node = len(parent)
        parent.append(up)
        tag.append(kind)
        names.append(named)
        marked.append(mark)
        verbatim.append(pre)
        link.append(0)
        parts.append([])
        run.append(node)
        run[up] = -1
        return node

    def add_text(t: str) -> None:
        if not t:
            return
        node = stack[-1][1]
        to = run[node]
        if t.isspace():
            if to >= 0 and parts[to]:  # blanks between inline elements
                parts[to].append(t)
            return
        if to < 0:
            to = add_node(node, tag[node], names[node], marked[node], verbatim[node])
            run[node] = to
        if "&" in t:
            t = entities.unescape(t)
        parts[to].append(t)
        if links:
            link[to] += len(t)

    for m in _TOKEN.finditer(source):
        if m.start() > at and not head:
            add_text(source[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "head":
            head = not m[2]
            continue
        if name == "title":
            continue
        if name == "body":
            head = False
            continue
        if name == "html" or name in _VOID:
            if name in ("br", "hr") and not head:
                add_text("\n")
            continue
        if name in _INLINE:
            if name == "a":
                links = 0 if m[2] else 1
            continue
        links = 0
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        head = False
        if stack[-1][0] == "p":
            stack.pop()
        if name in _CLOSES:
            ends, bounds = _CLOSES[name]
            k = len(stack) - 1
            found = 0
            while k > 0 and stack[k][0] not in bounds:
                if stack[k][0] in ends:
                    found = k
                k -= 1
            if found:
                del stack[found:]
        up = stack[-1][1]
        mark = name in _MARKS
        has_mark |= mark
        kind = 0
        attrs = m[4]
        if attrs and not attrs.isspace():
            said = " ".join(_NAMES.findall(attrs))
            if said:
                kind = (1 if _GOOD.search(said) else 0) | (2 if _BAD.search(said) else 0)
        node = add_node(up, _TAG.get(name, len(TAGS) - 1), kind, marked[up] or mark, verbatim[up] or name == "pre")
        if not attrs or not attrs.endswith("/"):
            stack.append((name, node))
    if at < len(source) and not head:
        add_text(source[at:])
    text = [("".join(p).strip("\r\n") if v else _SPACE.sub(" ", "".join(p)).strip()) if p else "" for p, v in zip(parts, verbatim)]
    return Page(parent, tag, text, link, names, marked, has_mark)


@dataclass
class Forest:
    """Many pages' nodes in one: features x, parents (-1: root), kinds of edges, depths, and the first node of each page."""

    x: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]
    first: np.ndarray


N_FEATURES = 16 + len(TAGS)


def forest(pages: list[Page]) -> Forest:
    first = np.concatenate([[0], np.cumsum([len(p.parent) for p in pages])]).astype(np.int64)
    n = int(first[-1])
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    parent = np.fromiter((q for p in pages for q in p.parent), np.int64, n)
    parent = np.where(parent >= 0, parent + first[page], -1)
    tag = np.fromiter((q for p in pages for q in p.tag), np.int64, n)
    names = np.fromiter((q for p in pages for q in p.names), np.int64, n)
    size = np.fromiter((len(t) for p in pages for t in p.text), np.int64, n).astype(float)
    word = np.fromiter((t.count(" ") + (t != "") for p in pages for t in p.text), np.int64, n).astype(float)
    punct = np.fromiter((len(_PUNCT.findall(t)) for p in pages for t in p.text), np.int64, n).astype(float)
    link = np.fromiter((q for p in pages for q in p.link), np.int64, n).astype(float)
    depth = np.zeros(n, np.int64)
    levels = [np.flatnonzero(parent < 0)]
    order = np.argsort(parent, kind="stable")
    ranked = parent[order]
    while len(levels[-1]):
        lo, hi = np.searchsorted(ranked, levels[-1], "left"), np.searchsorted(ranked, levels[-1], "right")
        k = hi - lo
        child = order[np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())] if k.sum() else np.zeros(0, np.int64)
        depth[child] = len(levels)
        levels.append(child)
    levels.pop()
    under, under_link, children = size.copy(), link.copy(), np.zeros(n)
    for level in reversed(levels[1:]):
        np.add.at(under, parent[level], under[level])
        np.add.at(under_link, parent[level], under_link[level])
        np.add.at(children, parent[level], 1)
    total = np.maximum(under[first[:-1]][page], 1) if n else np.zeros(0)
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = (before - before[first[:-1]][page]) / total if n else before
    s = np.maximum(size, 1)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.log1p(size) / 5
    x[:, 2] = np.log1p(word) / 4
    x[:, 3] = np.minimum(link / s, 1)
    x[:, 4] = np.minimum(punct / np.maximum(word, 1), 1)
    x[:, 5] = np.log1p(under) / 7
    x[:, 6] = np.minimum(under_link / np.maximum(under, 1), 1)
    x[:, 7] = under / total
    x[:, 8] = place
    x[:, 9] = place * place
    x[:, 10] = np.minimum(depth, 20) / 5
    x[:, 11] = np.log1p(children) / 3
    x[:, 12] = names & 1
    x[:, 13] = names >> 1
    x[:, 14] = size == 0
    x[:, 15] = (under_link == under) & (under > 0)
    x[np.arange(n), 16 + tag] = 1
    edge = np.where(size == 0, 0, np.where(tag == _TAG["p"], 1, 2))
    return Forest(x, parent, edge, levels, first)


def _softmax(a: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(a - a.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def marginals(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product in logarithms: (n, 2) node marginals and (n, 2, 2) marginals of (parent, node), zero at roots.

    unary: score of being content; pair: (EDGES, parent, child) scores.
    """
    n = len(unary)
    up = np.zeros((n, 2))
    up[:, 1] = unary
    sent = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        both = pair[f.edge[level]] + up[level][:, None, :]
        top = both.max(axis=2)
        sent[level] = top + np.log(np.exp(both - top[:, :, None]).sum(axis=2))
        np.add.at(up, f.parent[level], sent[level])
    belief = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    if n:
        belief[f.levels[0]] = _softmax(up[f.levels[0]])
    for level in f.levels[1:]:
        child = _softmax(pair[f.edge[level]] + up[level][:, None, :], 2)  # of the node, given its parent
        joint[level] = belief[f.parent[level]][:, :, None] * child
        belief[level] = joint[level].sum(axis=1)
    return belief, joint


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Each page's marginals of being content, by node."""
        f = forest(pages)
        p = marginals(f, f.x @ self.weights, self.pair)[0][:, 1]
        return [p[a:b] for a, b in zip(f.first, f.first[1:])]


def _default() -> Model:
    """Without labelled pages: long text, punctuation and paragraphs speak for content, links and names against it."""
    w = np.zeros(N_FEATURES)
    w[[0, 1, 3, 4, 6, 12, 13]] = (-3.0, 3.0, -4.0, 4.0, -2.0, 1.0, -3.0)
    for t, v in (("p", 1.5), ("nav", -3.0), ("footer", -3.0), ("header", -2.0), ("aside", -3.0), ("form", -2.0)):
        w[16 + TAGS.index(t)] = v
    pair = np.zeros((EDGES, 2, 2))
    pair[:, 1, 1], pair[:, 1, 0] = 0.7, -0.3
    return Model(w, pair)


def fit(pages: list[Page], steps: int = 250, rate: float = 0.08, ridge: float = 1e-3) -> Model:
    """Weights of greatest conditional likelihood on pages with marks, by gradients from the exact marginals."""
    pages = [p for p in pages if p.has_mark]
    if not pages:
        return _default()
    f = forest(pages)
    y = np.fromiter((q for p in pages for q in p.marked), np.int64, len(f.parent))
    w, pair = np.zeros(N_FEATURES), np.zeros((EDGES, 2, 2))
    inner = np.flatnonzero(f.parent >= 0)
    seen = np.zeros_like(pair)
    np.add.at(seen, (f.edge[inner], y[f.parent[inner]], y[inner]), 1)
    target = f.x.T @ y
    moment = [np.zeros_like(w), np.zeros_like(pair)], [np.zeros_like(w), np.zeros_like(pair)]
    n = len(y)
    for t in range(1, steps + 1):
        belief, joint = marginals(f, f.x @ w, pair)
        expected = np.zeros_like(pair)
        for e in range(EDGES):
            expected[e] = joint[inner[f.edge[inner] == e]].sum(axis=0)
        grads = ((target - f.x.T @ belief[:, 1]) / n - ridge * w, (seen - expected) / n - ridge * pair)
        for i, g in enumerate(grads):
            moment[0][i] = 0.9 * moment[0][i] + 0.1 * g
            moment[1][i] = 0.999 * moment[1][i] + 0.001 * g * g
            step = rate * (moment[0][i] / (1 - 0.9**t)) / (np.sqrt(moment[1][i] / (1 - 0.999**t)) + 1e-8)
            if i == 0:
                w = w + step
            else:
                pair = pair + step
    return Model(w, pair)


def train(pages: DataFrame, max_pages: int = MAX_PAGES, id_col: str = "page_id", html_col: str = "html") -> Model:
    """A model from at most max_pages pages that mark their content, chosen by a hash of the page.

    Null and empty pages mark nothing; repeated pages have one hash and count each; without marked pages, as in an empty
    table, the model is a fixed one; pages are read whole; other columns are not read.
    """
    h = F.col(f"`{html_col}`")
    some = bounded_sample(pages.where(h.rlike(r"(?i)<(article|main)[\s>]")).select(h.alias("h")), max_pages, F.xxhash64("h"))
    return fit([parse(r["h"]) for r in some.collect()])


def extract(pages: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, content, n_blocks, n_content) for every row: texts of the blocks whose marginal reaches threshold, by line.

    One pass, no shuffle. A null page gives nulls, an empty one empty content; text without tags is one block; broken
    markup gives some tree; a block at the threshold itself is content; very long pages are read whole; repeated rows and
    null ids keep a row each; other columns are not read; an empty table gives no rows. Texts stand in document order; a
    block of <pre> keeps its lines.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(1).to_pylist()
            out: list[str | None] = [None] * len(sources)
            blocks: list[int | None] = [None] * len(sources)
            kept: list[int | None] = [None] * len(sources)
            at = 0
            while at < len(sources):
                held, to = 0, at
                while to < len(sources) and (to == at or held + len(sources[to] or "") <= AT_ONCE):
                    held += len(sources[to] or "")
                    to += 1
                rows = [i for i in range(at, to) if sources[i] is not None]
                trees = [parse(sources[i]) for i in rows]
                for i, page, p in zip(rows, trees, model.content(trees)):
                    texts = [t for t, q in zip(page.text, p.tolist()) if t and q >= threshold]
                    out[i], blocks[i], kept[i] = "\n".join(texts), sum(t != "" for t in page.text), len(texts)
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "content", "n_blocks", "n_content"])

    return narrow(pages, id_col, html_col).mapInArrow(run, f"page_id {id_type}, content string, n_blocks int, n_content int")
