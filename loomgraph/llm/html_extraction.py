"""Main text of HTML pages by a tree-structured graphical model.

Each DOM node has a hidden state, content or not. A node's state depends on its parent's (a potential for each kind of
node), and what is seen of the node, its tag, its attributes' words, and how much text, punctuation and link text lies
beneath it, depends on its state. Sum-product messages passed from the leaves up to the root and back down give each
node's exact marginal probability of being content; text nodes of at least one half are kept.

The tables are counted on labelled pages. A page is labelled where its author marked the main part by <article> or
<main>; the model doesn't see these two tags, so what it learns carries over to pages without them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import col, read

#: Pages that the model is trained on, at most: those of smallest hash of the identifier.
MOST_PAGES = 1500

_NAME = re.compile(r"/?([a-z][a-z0-9:-]*)", re.IGNORECASE)
_STOP = re.compile(r"[<>\"']")
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "svg", "textarea")}
_WORDS = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.IGNORECASE)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "dl", "dt", "dd", "figure", "hr", "body", "html", "head", "title", "address"}
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "table", "dl", "select", "body", "article", "main", "div", "section"}
_MARKED = {"article", "main"}
#: The tags that others close, in the order of the places that an open element remembers.
_NEAR = {t: i for i, t in enumerate(("p", "li", "tr", "td", "th", "dt", "dd", "option"))}
#: Elements nested deeper than this are children of the one at this depth, as browsers have it.
DEEPEST = 512
_TAGS = ["#text", "p", "div", "a", "li", "ul", "ol", "span", "b", "strong", "i", "em", "h1", "h2", "h3", "h4", "table", "tr", "td", "nav", "header", "footer", "aside", "form", "button", "section", "blockquote", "pre", "code", "title", "head", "body", "html", "img", "br", "label", "select", "option", "figure", "dl"]
_TAG = {t: i for i, t in enumerate(_TAGS)}
_HINTS = [re.compile(p, re.IGNORECASE) for p in (r"\bads?\b|advert|promo|sponsor|banner", r"nav|menu|breadcrumb|sidebar|widget|related", r"foot|copyright|legal|cookie|share|social", r"comment|reply", r"article|content|main|post|story|entry|text")]
#: Kinds of node for the parent-child potentials, and numbers of values of the features.
KINDS = len(_TAGS) + 1
SIZES = (len(_TAGS) + 1, len(_HINTS) + 1, 8, 6, 5, 6, len(_TAGS) + 1)


def _tags(s: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(from, to, name, whether it closes, attributes) of the tags of a page in order; of comments, declarations, and
    elements whose content isn't text, without a name. A tag in which another one begins ends there, one without an end
    takes all that is left, and a quote that isn't closed is a sign like any other. No sign is looked at twice."""
    at, unclosed = 0, set()
    while (start := s.find("<", at)) >= 0:
        at = start + 1
        if s.startswith("!--", at):
            end = s.find("-->", at + 3)
            at = end + 3 if end >= 0 else len(s)
            yield start, at, "", False, ""
        elif s[at : at + 1] in ("!", "?"):
            end = s.find(">", at)
            at = end + 1 if end >= 0 else len(s)
            yield start, at, "", False, ""
        elif m := _NAME.match(s, at):
            first = at = m.end()
            end = len(s)
            while stop := _STOP.search(s, at):
                c, end = stop[0], stop.start()
                if c == ">" or c == "<":
                    break
                at = end + 1
                end = len(s)
                if c not in unclosed:
                    if (other := s.find(c, at)) >= 0:
                        at = other + 1
                    else:
                        unclosed.add(c)
            at = end + (s[end : end + 1] == ">")
            tag = m[1].lower()
            closing = m[0][0] == "/"
            if tag in _RAW and not closing:
                last = _RAW[tag].search(s, at)
                at = last.end() if last else len(s)
                yield start, at, "", False, ""
            else:
                yield start, at, tag, closing, s[first:end]


class Nodes:
    """The nodes of some pages, a page's in document order, a parent before its children: page, parent (-1 for a root),
    depth, features, text, whether a block begins at it, and whether it lies in a marked part."""

    def __init__(self) -> None:
        self.page: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.hint: list[int] = []
        self.text: list[str | None] = []
        self.block: list[int] = []
        self.marked: list[bool] = []
        self.has_mark: list[bool] = []

    def add(self, page: int, parent: int, tag: str, hint: int, text: str | None, block: int, marked: bool) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.hint.append(hint)
        self.text.append(text)
        self.block.append(block)
        self.marked.append(marked)
        return len(self.page) - 1

    def parse(self, source: str | None) -> None:
        """Adds a page. Unclosed and wrongly nested tags are mended as browsers do for paragraphs, list items and
        cells; a closing tag that closes nothing is left out. The time is linear in the page's length."""
        page, at, block, seen = len(self.has_mark), 0, 0, False
        # name, node, whether in a marked part, and for each tag of _NEAR the nearest open one in scope, 0 if none
        stack = [("#root", self.add(page, -1, "#root", 0, None, 0, False), False, (0,) * len(_NEAR))]
        n_open: Counter = Counter()

        def close(k: int) -> None:
            n_open.subtract(x[0] for x in stack[k:])
            del stack[k:]

        def text(raw: str) -> None:
            if raw and not raw.isspace():
                _, parent, marked, _ = stack[min(len(stack), DEEPEST) - 1]
                self.add(page, parent, "#text", 0, entities.unescape(raw) if "&" in raw else raw, block, marked)

        for start, end, tag, closing, attrs in _tags(source or ""):
            text(source[at:start])
            at = end
            if not tag:
                continue
            if tag in _BLOCK or tag == "br":
                block += 1
            if closing:
                if n_open[tag] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            if tag in _BLOCK and (k := stack[-1][3][_NEAR["p"]]):
                close(k)
            if tag in _CLOSES and (k := max(stack[-1][3][_NEAR[t]] for t in _CLOSES[tag])):
                close(k)
            hint = 0
            if attrs and (words := " ".join(_WORDS.findall(attrs))):
                hint = next((i + 1 for i, p in enumerate(_HINTS) if p.search(words)), 0)
            _, parent, marked, _ = stack[min(len(stack), DEEPEST) - 1]
            near = stack[-1][3]
            marked = marked or tag in _MARKED
            seen = seen or tag in _MARKED
            i = self.add(page, parent, "div" if tag in _MARKED else tag, hint, None, block, marked)
            if tag not in _VOID and not attrs.endswith("/"):
                if tag in _SCOPE:
                    near = (0,) * len(_NEAR)
                elif tag in _NEAR:
                    near = (*near[: _NEAR[tag]], len(stack), *near[_NEAR[tag] + 1 :])
                stack.append((tag, i, marked, near))
                n_open[tag] += 1
        text((source or "")[at:])
        self.has_mark.append(seen)

    def finish(self) -> None:
        n = len(self.page)
        self.up = np.array(self.parent, np.int64)
        self.level = np.array(self.depth, np.int64)
        kind = np.array([_TAG.get(t, len(_TAGS)) for t in self.tag], np.int64)
        own = np.array([len(t) if t else 0 for t in self.text], float)
        dots = np.array([sum(map(t.count, ".!?,;:")) if t else 0 for t in self.text], float)
        link = np.zeros(n)
        anchor = _TAG["a"]
        in_link = kind == anchor
        self.order = np.argsort(self.level, kind="stable")
        cut = np.searchsorted(self.level[self.order], np.arange((self.level.max() if n else -1) + 2))
        self.levels = [self.order[cut[i] : cut[i + 1]] for i in range(len(cut) - 1)]
        for at in self.levels[1:]:
            in_link[at] |= in_link[self.up[at]]
        link[in_link] = own[in_link]
        sums = np.stack([own, dots, link], 1)
        for at in reversed(self.levels[1:]):
            np.add.at(sums, self.up[at], sums[at])
        self.kind = kind
        size, dots, link = sums.T
        over = np.where(self.up >= 0, kind[self.up], len(_TAGS))
        bucket = lambda x, edges: np.searchsorted(edges, x, "right")
        share = np.divide(link, size, out=np.zeros(n), where=size > 0)
        density = np.divide(dots, size, out=np.zeros(n), where=size > 0)
        self.features = np.stack([kind, np.array(self.hint, np.int64), bucket(size, [1, 10, 25, 60, 150, 500, 2000]), bucket(share, [1e-9, 0.2, 0.5, 0.9, 1.0]), bucket(density, [1e-9, 0.005, 0.02, 0.06]), np.minimum(self.level, 10) // 2, over], 1)


@dataclass
class Model:
    """Logarithms: of the root's state; of a child's state given its parent's, by the child's kind [kind, parent,
    child]; of each feature's value given the state [state, value]."""

    root: np.ndarray
    edges: np.ndarray
    seen: list[np.ndarray]

    def marginals(self, t: Nodes) -> np.ndarray:
        """Each node's probability of being content."""
        n = len(t.page)
        own = np.zeros((n, 2))
        for j, table in enumerate(self.seen):
            own += table[:, t.features[:, j]].T
        up = own.copy()  # a node's own evidence and the messages of its children
        to_parent = np.zeros((n, 2))
        edge = self.edges[t.kind]
        for at in reversed(t.levels[1:]):
            to_parent[at] = np.logaddexp(edge[at, :, 0] + up[at, None, 0], edge[at, :, 1] + up[at, None, 1])
            np.add.at(up, t.up[at], to_parent[at])
        down = np.zeros((n, 2))
        if n:
            down[t.levels[0]] = self.root
        for at in t.levels[1:]:
            p = t.up[at]
            rest = down[p] + up[p] - to_parent[at]  # all that the parent knows but for this child
            down[at] = np.logaddexp(rest[:, 0, None] + edge[at, 0, :], rest[:, 1, None] + edge[at, 1, :])
        b = down + up
        return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -700, 700)))


def parse(pages: list[str | None]) -> Nodes:
    t = Nodes()
    for p in pages:
        t.parse(p)
    t.finish()
    return t


def train(pages: list[str | None]) -> Model:
    """Counts, with one more for each case, over the pages that have a marked part. Without such pages all tables are
    uniform, and every node's marginal is one half."""
    t = parse(pages)
    use = np.array(t.has_mark, bool)[np.array(t.page, np.int64)] if t.page else np.zeros(0, bool)
    y = np.array(t.marked, np.int64)
    root = np.ones(2)
    edges = np.ones((KINDS, 2, 2))
    seen = [np.ones((2, s)) for s in SIZES]
    top = use & (t.up < 0)
    np.add.at(root, y[top], 1)
    low = use & (t.up >= 0)
    np.add.at(edges, (t.kind[low], y[t.up[low]], y[low]), 1)
    for j, s in enumerate(seen):
        np.add.at(s, (y[use], t.features[use, j]), 1)
    return Model(np.log(root / root.sum()), np.log(edges / edges.sum(2, keepdims=True)), [np.log(s / s.sum(1, keepdims=True)) for s in seen])


def extract(pages: list[str | None], model: Model) -> list[str | None]:
    """The main text of each page, a line for each block; None for None."""
    t = parse(pages)
    keep = model.marginals(t) >= 0.5
    out: list[list[str]] = [[] for _ in pages]
    last = [-1] * len(pages)
    blank = [False] * len(pages)  # after what the page has so far, if more of the block follows
    for i, text in enumerate(t.text):
        if text is not None and keep[i]:
            p, words = t.page[i], " ".join(text.split())
            if not words:
                continue
            if t.block[i] == last[p]:
                out[p].append((" " if text[0].isspace() or blank[p] else "") + words)
            else:
                out[p].append(("\n" if out[p] else "") + words)
                last[p] = t.block[i]
            blank[p] = text[-1].isspace()
    return [None if s is None else "".join(o) for s, o in zip(pages, out)]


def train_pages(pages: DataFrame, most: int = MOST_PAGES, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The model of at most so many marked pages, those of smallest hash of identifier. NULL pages and empty ones are
    never marked; rows that agree in identifier and page count once; no rows give uniform tables."""
    rows = pages.where(col(html_col).rlike(r"(?i)<(article|main)\b")).select(col(id_col).alias("id"), col(html_col).alias("html"))
    # pages are told apart by hashes, so that few are sent, and no more than so many, however often a row is repeated
    rows = rows.withColumn("page", F.xxhash64("html"))
    ids = rows.select("id", "page").orderBy(F.xxhash64("id"), "id", "page").limit(most).distinct()
    chosen = rows.join(F.broadcast(ids), (rows.id.eqNullSafe(ids.id)) & (rows.page == ids.page), "left_semi")
    pdf: pd.DataFrame = chosen.groupBy("id", "page").agg(F.first("html").alias("html")).toPandas().sort_values(["id", "html"])
    return train(pdf["html"].tolist())


def extract_pages(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", at_once: int = 64) -> DataFrame:
    """(page_id, text) for each row. NULL stays NULL; an empty page, or one without content, gives an empty text. Of
    a page without tags all is one text node. Repeated rows each appear, with equal results. No rows give no rows."""

    def apply(batches):
        for b in batches:
            out: list[str | None] = []
            for i in range(0, b.num_rows, at_once):
                out += extract(b.column(1).slice(i, at_once).to_pylist(), model)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["page_id", "text"])

    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return pages.select(col(id_col), col(html_col)).mapInArrow(apply, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_pages() of all pages, by a model of some marked ones."""
    pages = read(spark, sf_dir, "pages")
    return extract_pages(pages, train_pages(pages))
