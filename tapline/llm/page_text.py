"""Main text of web pages: boosted trees over the nodes of the page, decoded along its hierarchy."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import id_and_text, id_type, text_slices

# Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select option button textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl body html article section div".split())

# Words in class, id and role values that name what an element is for; the weak labels of training rest on them.
AWAY = frozenset(
    "ad ads adbox advert advertisement adverts sponsored promo promotion banner cookie cookies consent notice notices alert sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer foot bottom comment comments reply replies discussion disqus share sharing social related recommended more newsletter "
    "subscribe signup login search form popup modal widget tags pagination pager copyright legal toolbar tooltip byline meta".split()
)
MAIN = frozenset("article content main post entry story body text maincontent articlebody hentry prose".split())
AWAY_TAGS = frozenset("nav footer header aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
TAGS = ("nav", "footer", "header", "aside", "form", "article", "main", "section", "div", "p", "li", "ul", "table", "td", "blockquote", "pre", "body", "h1", "h2", "#text")
MEANING = 7  # the first so many tags say by name what they are
HASHED = 16

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/][^>]*>", re.S)
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_NAMING = re.compile(r"\b(?:class|id|role)$", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    """A block element, or ("#text") a run of text between two block boundaries."""

    tag: str
    parent: int
    depth: int
    tokens: list[str] = field(default_factory=list)
    text: str = ""
    links: int = 0
    hidden: bool = False


def tag_end(page: str, at: int, spent: set[str]) -> int:
    """Place after the '>' of a tag whose name ends at ``at``, or -1 if there is none.

    A quote after '=' holds a value up to the next such quote, however far. Without one in the page it is
    plain; ``spent`` remembers that for each kind of quote, and '>' for a page without a further tag end.
    """
    start = at
    while ">" not in spent and (stop := _STOP.search(page, at)):
        at = stop.end()
        if not stop[1]:
            return at
        if stop[1] not in spent:
            end = page.find(stop[1], at)
            if end < 0:
                spent.add(stop[1])
            else:
                at = end + 1
    if ">" not in spent:  # the page ends inside this tag: no quote holds anything from here on
        spent.update(">\"'")
    return page.find(">", start) + 1 or -1


def parse(page: str) -> list[Node]:
    """Block nodes of a page in page order; node 0 is the root."""
    nodes = [Node("#root", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the block node each stands in
    run: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            at = stack[-1][1]
            nodes.append(Node("#text", at, nodes[at].depth + 1, text=text, links=min(linked, len(text)), hidden=nodes[at].hidden))
        run, linked = [], 0

    def close(upto: int) -> None:
        nonlocal links
        for tag, _ in stack[upto:]:
            if tag not in INLINE:
                flush()
            links -= tag == "a"
        del stack[upto:]

    at, spent = 0, set()
    while True:
        found, end = _TAG.search(page, at), 0
        while found and found[2] and (end := tag_end(page, found.end(), spent)) < 0:
            found = _TAG.search(page, found.end())
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            run.append(piece)
            if links > 0:
                linked += len(piece)
        if not found:
            break
        at = end if found[2] else found.end()
        inner = page[found.end() : at - 1]
        tag = found[2].lower() if found[2] else ""
        if not tag:
            continue
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    close(i)
                    break
            continue
        if tag in ("br", "wbr", "img"):
            run.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        ends = CLOSES.get(tag, {"p"} if tag in CLOSES_P else ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                flush()
                close(i)
                break
            if stack[i][0] in SCOPE and tag != "p" or stack[i][0] in ("td", "th", "li", "body", "article", "div") and tag in CLOSES_P:
                break
        inside = stack[-1][1]
        if tag not in INLINE:
            tokens = [t for m in _ATTRIBUTE.finditer(inner) if _NAMING.search(m[1]) for t in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())]
            nodes.append(Node(tag, inside, nodes[inside].depth + 1, tokens, hidden=nodes[inside].hidden or tag in HIDDEN or tag in VOID))
            inside = len(nodes) - 1
        if tag in VOID or inner.endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, inside))
        links += tag == "a"
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            flush()
            if tag == "title" or tag == "textarea":
                pass
            at = end.end() if end else len(page)
            stack.pop()
    flush()
    return nodes


NAMES = [*(f"tag {t}" for t in TAGS), "away", "main", *(f"token {i}" for i in range(HASHED)), "in away", "in main"]
SEMANTIC = len(NAMES)
NAMES += ["depth", "chars", "links", "density", "words", "stops", "nodes", "place", "siblings", "alike", "sibling chars", "share", "next chars", "former chars", "symbols"]


def page_holders(nodes: list[Node], chars: np.ndarray) -> np.ndarray:
    """Nodes that no name sets aside: html and body, and wrappers and articles of most of the page's text.

    A wrapper holds most of the text and in it a main or article element or a first heading of the page; an
    article or main element holds most of the text of the outermost node that a name sets aside.
    """
    out, heads = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    marked = [-1] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        lead = x.tag == "h1" or x.tag in MAIN_TAGS and 2 * chars[i] > chars[0]
        heads[x.parent] |= heads[i] or lead
    for i, x in enumerate(nodes):
        if i:
            marked[i] = marked[x.parent]
            most = 2 * chars[i] > chars[0]
            if x.tag in ("html", "body") or x.tag not in AWAY_TAGS - {"form"} and most and (heads[i] or x.tag in MAIN_TAGS):
                out[i], marked[i] = True, -1
            elif x.tag in MAIN_TAGS and marked[i] >= 0 and 2 * chars[i] > chars[marked[i]]:
                out[i], marked[i] = True, -1
            elif marked[i] < 0 and (x.tag in AWAY_TAGS or any(t in AWAY for t in x.tokens)):
                marked[i] = i
    return out


def describe(nodes: list[Node]) -> np.ndarray:
    """Features of every node: tag, attribute tokens, depth, subtree density and sibling statistics."""
    n = len(nodes)
    out = np.zeros((n, len(NAMES)), np.float32)
    parent = np.array([x.parent for x in nodes])
    chars, links, words, stops, inner, symbols = (np.zeros(n) for _ in range(6))
    children: list[list[int]] = [[] for _ in range(n)]
    for i, x in enumerate(nodes):
        if x.text and not x.hidden:
            chars[i], links[i], words[i] = len(x.text), x.links, x.text.count(" ") + 1
            stops[i] = sum(map(x.text.count, ".,!?;:"))
            symbols[i] = sum(map(x.text.count, "|©»›"))
        if i:
            children[x.parent].append(i)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for total in (chars, links, words, stops, symbols):
            total[p] += total[i]
        inner[p] += inner[i] + 1
    holds = page_holders(nodes, chars)
    for i, x in enumerate(nodes):
        if x.tag in TAGS:
            out[i, TAGS.index(x.tag)] = 1
        k = len(TAGS)
        out[i, k] = sum(t in AWAY for t in x.tokens)
        out[i, k + 1] = sum(t in MAIN for t in x.tokens)
        for t in x.tokens:
            out[i, k + 2 + sum(t.encode()) % HASHED] = 1
        main = x.tag in MAIN_TAGS or out[i, k + 1] > 0 or i > 0 and out[x.parent, SEMANTIC - 1] > 0
        named = {*(t for t in x.tokens if t in AWAY), *({x.tag} & AWAY_TAGS)} - ({"header"} if main else set())
        out[i, SEMANTIC - 2] = not holds[i] and (bool(named) or i > 0 and out[x.parent, SEMANTIC - 2] > 0)
        out[i, SEMANTIC - 1] = main
    total = max(1.0, chars[0])
    for p, mine in enumerate(children):
        for place, i in enumerate(mine):
            rest = (chars[p] - chars[i]) / max(1, len(mine) - 1)
            out[i, SEMANTIC:] = (
                nodes[i].depth, np.log1p(chars[i]), links[i] / max(1, chars[i]), chars[i] / (inner[i] + 1), np.log1p(words[i]), stops[i] / max(1, words[i]), np.log1p(inner[i]),
                place / len(mine), len(mine), sum(nodes[j].tag == nodes[i].tag for j in mine[max(0, place - 8) : place + 9]), np.log1p(rest), chars[i] / total,
                np.log1p(chars[mine[place + 1]]) if place + 1 < len(mine) else 0, np.log1p(chars[mine[place - 1]]) if place else 0, symbols[i] / max(1, words[i]),
            )
    return out


def weak_labels(nodes: list[Node], features: np.ndarray) -> np.ndarray | None:
    """1 for nodes of a page that hold its main text, judged by names alone; None if nothing names it."""
    away = (features[:, SEMANTIC - 2] > 0) | np.array([x.hidden for x in nodes])
    label = (features[:, SEMANTIC - 1] > 0) & ~away & (features[:, SEMANTIC + 1] > 0)
    if not label.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        label[nodes[i].parent] |= label[i]
    return label.astype(np.float64)


def prior(features: np.ndarray) -> np.ndarray:
    """Log-odds at which boosting starts: what an element's own or an outer name says, 0 if nothing does.

    The trees add to it, so a kind of element that no training page has still follows its name.
    """
    return np.where(features[:, SEMANTIC - 2] > 0, -8.0, np.where(features[:, SEMANTIC - 1] > 0, 6.0, 0.0))


@dataclass
class BoostedTrees:
    """Logistic gradient boosting from a prior, with trees of a fixed depth over binned features."""

    depth: int
    bias: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2**depth

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 24, least: float = 1.0) -> BoostedTrees:
        inner = 2**depth - 1
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        model = cls(depth, float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**depth)))
        if not len(y):
            return model
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        flat, width = binned + np.arange(x.shape[1]) * bins, x.shape[1] * bins
        splits = np.stack([np.arange(bins) < len(e) for e in edges])
        score = model.bias + prior(x)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            where = np.zeros(len(y), np.int64)
            for node in range(inner):
                rows = np.flatnonzero(where == node)
                right = np.zeros(len(rows), bool)
                if len(rows) > 1:
                    at = flat[rows].ravel()
                    gl = np.bincount(at, np.repeat(g[rows], x.shape[1]), width).reshape(-1, bins).cumsum(axis=1)
                    hl = np.bincount(at, np.repeat(h[rows], x.shape[1]), width).reshape(-1, bins).cumsum(axis=1)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[~splits | (hl < least) | (hs - hl < least)] = 0
                    f, cut = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, cut] > 1e-6:
                        model.features[t, node], model.cuts[t, node] = f, edges[f][cut]
                        right = binned[rows, f] > cut
                where[rows] = 2 * node + 1 + right
            leaf = where - inner
            model.leaves[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            score += model.leaves[t][leaf]
        return model

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = self.bias + prior(x), np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, features[at]] > cuts[at])
            out += leaves[at - (2**self.depth - 1)]
        return out


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes in which no node is kept under one that is not.

    From the leaves upwards, each node weighs dropping its whole subtree against being kept with the best
    choice for every child.
    """
    keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    weight = np.array([1.0 + np.log1p(len(x.text)) for x in nodes])
    keep, drop = keep * weight, drop * weight
    best_kept, all_dropped = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        best_kept[p] += max(best_kept[i], all_dropped[i])
        all_dropped[p] += all_dropped[i]
    kept = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        kept[i] = not x.hidden and (i == 0 or kept[x.parent]) and best_kept[i] > all_dropped[i]
    return kept


def join_blocks(nodes: list[Node], kept: np.ndarray) -> str:
    return "\n\n".join(x.text for x, k in zip(nodes, kept, strict=True) if k and x.text)


def train_pages(pages: DataFrame, max_pages: int = 300, id_col: str = "page_id", html_col: str = "html") -> BoostedTrees:
    """Fit the trees on weakly labelled nodes.

    At most ``max_pages`` pages, those with the least hash of their id, are read: a documented bound on what
    is broadcast (ids) and collected (node features). Each counts twice, once with the features that name
    an element's purpose blanked, so that density and siblings carry pages that name nothing.
    """
    rows = id_and_text(pages, id_col, html_col).filter("id IS NOT NULL AND text IS NOT NULL")
    few = rows.select("id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_pages).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            x, y = [], []
            for text in texts:
                nodes = parse(text)
                features = describe(nodes)
                label = weak_labels(nodes, features)
                if label is not None:
                    seen = np.array([not n.hidden for n in nodes])
                    x.append(features[seen])
                    y.append(label[seen])
            if x:
                x, y = np.concatenate(x), np.concatenate(y)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), pa.array(y)], names=["x", "y"])

    made = rows.join(F.broadcast(few), "id").mapInArrow(run, "x array<float>, y double").toPandas()
    x = np.stack(made["x"].to_numpy()) if len(made) else np.zeros((0, len(NAMES)), np.float32)
    order = np.lexsort(x.T)
    x, y = x[order], made["y"].to_numpy(dtype=float)[order]
    blank = x.copy()
    blank[:, :MEANING] = 0
    blank[:, len(TAGS) : SEMANTIC] = 0
    return BoostedTrees.fit(np.concatenate([x, blank]), np.concatenate([y, y]))


def extract_text(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    The project keeps no web pages, so this operator is general. Returns ``page_id``, ``text`` (blocks in page
    order, joined by two line feeds; '' if there is none), ``n_nodes`` and ``n_kept`` (nodes); one row
    for each input row, repeated rows included. A null or empty page gives ''. Whole pages are parsed in
    one pass, unclosed and misnested tags included; character references are decoded and white space
    inside a block becomes one space. Other columns are not read. The trees have a fixed size; there is no
    shuffle.
    """
    shared, kind = pages.sparkSession.sparkContext.broadcast(model), id_type(pages, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for part, texts in text_slices(batches):
            parsed = [parse(t) for t in texts]
            logits = trees.logits(np.concatenate([describe(n) for n in parsed]))
            ends = np.cumsum([len(n) for n in parsed])[:-1]
            kept = [decode(n, s) for n, s in zip(parsed, np.split(logits, ends), strict=True)]
            made = [[join_blocks(n, k) for n, k in zip(parsed, kept, strict=True)], [len(n) for n in parsed], [int(k.sum()) for k in kept]]
            types = [pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, made, types)], names=["id", "text", "n_nodes", "n_kept"])

    return id_and_text(pages, id_col, html_col).mapInArrow(run, f"id {kind}, text string, n_nodes int, n_kept int").withColumnRenamed("id", id_col)
