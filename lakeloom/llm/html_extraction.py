"""Main text of web pages by a tree-structured graphical model.

The nodes of a page's tree are labelled 1 (main text) or 0. Each has a unary potential, a logistic model of what the node, its
subtree and its siblings show: kinds of tags, length, links, punctuation, paragraphs, headings, and hints in tag, class, id and role of itself and of
what it lies in. Each edge has a potential of the parent's and the child's label, one table for each kind of child (a text
block, a container, a part named by its tag). Sum-product messages up and down the tree give each node's exact marginal; text of nodes with a
marginal of a half or more is kept.

Training (piecewise: unary and edge potentials each by its own likelihood) uses labelled pages: a bounded sample of the table's
pages that mark their article (`most_pages`, those with the smallest hash of their id, up to MOST_CHARS code points each), each
as it is, with labelled foreign parts put into it, and with the marks hidden, and a few fixed pages. Hints are features like others: with marks hidden the model learns
to do without them. Extraction reads every page whole. A page of which nothing is kept though some of its text is in no part that looks foreign
keeps that text.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dom import IN, MAYBE, NONE, OUT, UNSURE, Page, parse

MOST_CHARS = 40_000
_KINDS = {k: i for i, ks in enumerate(["p blockquote pre dd figcaption", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt", "table tbody thead tfoot tr td th caption", "article main"]) for k in ks.split()}
_NAMED = frozenset("article main nav aside footer header form menu dialog search".split())
SIZE = 28
#: Kinds of a child: text block, container, part named by its tag.
EDGES = 3
_STOPS = (".", "!", "?", "…", ":", '"', "”", "»", "。")

#: Parts of pages that are not main text, put into training pages. {} stands for words of the page.
_FOREIGN = [
    '<div class="comments"><h3>{}</h3><div class="comment"><p>{}.</p></div><div class="comment"><p>{} {}.</p></div></div>',
    '<section id="comments"><ol><li>{}</li><li><p>{}. {}.</p></li></ol></section>',
    '<aside><p>{}.</p><ul><li><a href="/x">{}</a></li></ul></aside>',
    '<div class="sidebar"><p>{}. {}.</p></div>',
    '<div class="ad">{}. {}.</div>',
    '<div class="cookie-notice"><p>{}. {}.</p></div>',
    '<form action="/s"><label>{}</label><p>{}.</p></form>',
    '<div class="share"><a href="/y">{}</a> <a href="/z">{}</a></div>',
    '<ul class="related"><li><a href="/r">{}</a></li><li><a href="/q">{} {}</a></li></ul>',
    '<nav><a href="/">{}</a><a href="/n">{}</a></nav>',
    "<footer><p>{} {}.</p></footer>",
    '<p class="advertisement">{}. {}.</p>',
]
_FIXED = [
    '<html><body><header><h1>Site</h1><nav><a href="/">Home</a></nav></header><main><h1>A title</h1><p>One sentence of the text, long enough to read. Another sentence.</p><h2>Part</h2><p>More of it follows here, and ends.</p></main><footer>Footer words</footer></body></html>',
    '<html><body><div id="top"><a href="/a">A</a> <a href="/b">B</a></div><div class="content"><h1>Title words</h1><p>The first paragraph of a page says something.</p><ul><li>One point of a list.</li><li>A second point.</li></ul><table><tr><td>cell</td><td>another cell</td></tr></table></div><div class="footer"><p>All rights reserved.</p></div></body></html>',
    '<html><body><div class="post-body"><p>Text of a post without a heading. It goes on.</p><blockquote>Words that were quoted.</blockquote><pre>code here</pre></div><div id="sidebar"><p>Something else stands here.</p></div></body></html>',
    "<html><body><h1>Plain page</h1><p>A page without any hint has text in its body all the same.</p><p>So this belongs to it.</p></body></html>",
    "<html><body><div><p>A first part of a page without hints.</p><p>It has two paragraphs.</p></div><div><p>A second part follows it here.</p><p>This is the end of it.</p></div></body></html>",
    "<body>Nothing but text stands on this page. It has no markup at all.</body>",
    "<p>A single paragraph is the whole of it.</p>",
]


def edge_kind(tag: str) -> int:
    return 2 if tag in _NAMED else 0 if tag in _KINDS else 1


def features(page: Page) -> np.ndarray:
    """A row of SIZE values for each node: what it, its subtree, its siblings and what it lies in show."""
    n = len(page.parent)
    parent, tag, hint = page.parent, page.tag, page.hint
    chars, linked, last = [0] * n, [0] * n, [""] * n
    for _, node, text, link in page.pieces:
        text = text.strip()
        if text:
            chars[node] += len(text)
            linked[node] += len(text) * link
            last[node] = text[-1]
    below, below_linked, blocks, headed, children = chars[:], linked[:], [0] * n, [False] * n, [0] * n
    alike: dict[tuple[int, str], int] = {}
    for i in range(n - 1, 0, -1):
        p = parent[i]
        headed[i] = headed[i] or (tag[i] == "h1" and hint[i] != OUT)
        blocks[i] += tag[i] in ("p", "blockquote", "pre") and chars[i] > 0
        below[p] += below[i]
        below_linked[p] += below_linked[i]
        blocks[p] += blocks[i]
        headed[p] = headed[p] or (headed[i] and hint[i] != OUT)
        children[p] += 1
        alike[p, tag[i]] = alike.get((p, tag[i]), 0) + 1
    whole = max(1, below[0])
    marked = IN in hint or any(t in ("article", "main") for t in tag)
    out_of, in_of = [False] * n, [False] * n
    out = np.zeros((n, SIZE))
    out[:, 0] = 1
    for i in range(n):
        row, p = out[i], parent[i]
        out_of[i] = hint[i] == OUT or (p >= 0 and out_of[p])
        in_of[i] = hint[i] == IN or (p >= 0 and in_of[p])
        if (k := _KINDS.get(tag[i])) is not None:
            row[1 + k] = 1
        row[6] = hint[i] == OUT
        row[7] = out_of[i]
        row[8] = hint[i] == MAYBE
        row[9] = in_of[i]
        row[10] = marked and not in_of[i]
        if chars[i]:
            share = linked[i] / chars[i]
            row[11] = 1
            row[12] = min(3.0, math.log1p(chars[i]) / 3)
            row[13] = share
            row[14] = share > 0.6
            row[15] = last[i] in _STOPS
            row[16] = chars[i] < 30
            row[17] = chars[i] > 150
            row[18] = k is None and not children[i]
        row[19] = below[i] / whole
        row[20] = below_linked[i] / below[i] if below[i] else 0.0
        row[21] = min(3.0, math.log1p(blocks[i]))
        row[22] = headed[i]
        if p >= 0:
            row[23] = headed[p] and not headed[i]
            row[24] = below[p] / whole
            row[25] = below_linked[p] / below[p] if below[p] else 0.0
            row[26] = min(2.0, math.log(alike[p, tag[i]]) / 2) if chars[i] else 0.0
            row[27] = min(3.0, math.log1p(blocks[p]))
    return out


def _marked(page: Page) -> list[int] | None:
    """Labels of a page that marks its main text by an article or main element (or a content class); None if it does not."""
    inside, found = [0] * len(page.parent), False
    best = "article" if "article" in page.tag else "main" if "main" in page.tag else ""
    for i in range(1, len(page.parent)):
        p = page.parent[i]
        if page.hint[i] == OUT:
            inside[i] = 0 if inside[p] != 1 else -1
        elif inside[p] == -1:
            inside[i] = -1
        elif inside[p] == 1 or page.tag[i] == best or (not best and page.hint[i] == IN):
            inside[i], found = 1, True
    return [max(0, x) for x in inside] if found else None


def hidden(page: Page, rng: random.Random, part: float) -> Page:
    """The page with most of its marks hidden: named parts become plain containers, and each hint goes with the chance `part`."""
    out = Page()
    out.parent, out.pieces = page.parent, page.pieces
    gone = [rng.random() < part for _ in page.tag]
    out.tag = ["div" if g and t in _NAMED else t for t, g in zip(page.tag, gone, strict=True)]
    out.hint = [rng.choice([NONE, NONE, MAYBE]) if g else h for h, g in zip(page.hint, gone, strict=True)]
    return out


def _plain(page: Page) -> list[int]:
    """Labels of a fixed page without any hint: all that is not inside a foreign part."""
    out = [0] * len(page.parent)
    foreign = [False] * len(page.parent)
    for i in range(len(page.parent)):
        foreign[i] = page.hint[i] == OUT or (i > 0 and foreign[page.parent[i]])
        out[i] = int(not foreign[i] and page.tag[i] != "head")
    return out


@dataclass
class Model:
    """weights of the unary model; edges[kind of child, parent's label, child's label]: log probabilities of the child's label."""

    weights: np.ndarray
    edges: np.ndarray
    prior: float

    def marginals(self, page: Page) -> list[float]:
        """P(label 1) of every node, by one pass up and one down the tree (log odds; exact on a tree)."""
        n = len(page.parent)
        unary = (features(page) @ self.weights).tolist()
        tables, parent = self.edges.tolist(), page.parent
        edges = [tables[edge_kind(t)] for t in page.tag]
        # up[i]: log of the message ratio from i to its parent (1 against 0); belief[i]: unary and all children's messages
        belief, up = unary[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            (a00, a01), (a10, a11) = edges[i]
            b = belief[i]
            up[i] = _add(a10, a11 + b) - _add(a00, a01 + b)
            belief[parent[i]] += up[i]
        total = [0.0] * n
        total[0] = belief[0] + self.prior
        for i in range(1, n):
            (a00, a01), (a10, a11) = edges[i]
            rest = total[parent[i]] - up[i]
            total[i] = belief[i] + _add(a01, a11 + rest) - _add(a00, a10 + rest)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in total]


def _add(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def fit(pages: list[tuple[Page, list[int]]]) -> Model:
    """Piecewise training: a penalised logistic model of nodes, and counts of (kind of child, parent's label, child's label)."""
    x = np.concatenate([features(p) for p, _ in pages])
    y = np.concatenate([np.array(labels, float) for _, labels in pages])
    counts = np.ones((EDGES, 2, 2)) * 0.5
    for page, labels in pages:
        for i in range(1, len(labels)):
            counts[edge_kind(page.tag[i]), labels[page.parent[i]], labels[i]] += 1
    edges = np.log(counts / counts.sum(axis=2, keepdims=True))
    w = np.zeros(SIZE)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1.0 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(SIZE)
        w -= np.linalg.solve(curve, slope)
    # the edges hold the labels' frequencies, so the unary term keeps only what the node adds to them
    rate = (y.sum() + 1) / (len(y) + 2)
    w[0] -= math.log(rate / (1 - rate))
    roots = sum(labels[0] for _, labels in pages)
    return Model(w, edges, math.log((roots + 0.5) / (len(pages) - roots + 0.5)))


def labelled(sources: list[str]) -> list[tuple[Page, list[int]]]:
    """Training pages of sources that mark their article: each as it is, with foreign parts, with an own container around some
    of its text, and with marks hidden; and the fixed pages with more of them."""
    out = []
    for number, source in enumerate([*_FIXED, *sources]):
        fixed = number < len(_FIXED)
        rng = random.Random(number)
        words = re.findall(r"\w+", re.sub(r"<[^>]*>", " ", source))[:400] or ["word"]
        for version in range(16 if fixed else 3):
            text = source
            if version:
                for _ in range(1 + version % 3):
                    spots = [m.end() for m in re.finditer(r"</(?:p|h1|h2|div|article|nav)>|<body>", text)]
                    part = rng.choice(_FOREIGN)
                    while "{}" in part:
                        part = part.replace("{}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 25]))), 1)
                    spot = rng.choice(spots) if spots else len(text)
                    text = text[:spot] + part + text[spot:]
            if version % 2:
                # a paragraph in a container of its own, whatever its name
                spots = list(re.finditer(r"<p>[^<]*</p>", text))
                if spots:
                    m, name = rng.choice(spots), rng.choice([*sorted(UNSURE), "x1", "block"])
                    text = f'{text[: m.start()]}<div class="{name}">{m[0]}</div>{text[m.end() :]}'
            page = parse(text)
            labels = _marked(page)
            if labels is None and fixed:
                labels = _plain(page)
            if labels is not None:
                out += [(page, labels), (hidden(page, rng, rng.choice([0.5, 1.0])), labels)]
    return out


def train(pages: DataFrame, most_pages: int = 150) -> Model:
    """A model from the fixed pages and most_pages pages of the table at most. Of rows with one page_id the least html counts."""
    short = pages.where(F.length(F.col("html").cast("string")) <= MOST_CHARS).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    # first the ids, so that no task keeps more than numbers
    ids = short.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most_pages)
    rows = short.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    return fit(labelled([r.html for r in sorted(rows, key=lambda r: r.page_id)]))


def _foreign(page: Page) -> list[bool]:
    out = [False] * len(page.parent)
    for i in range(len(page.parent)):
        out[i] = page.hint[i] == OUT or page.tag[i] == "head" or (i > 0 and out[page.parent[i]])
    return out


def main_text(source: str, model: Model) -> str:
    """The page's main text: one line for each block that has some."""
    page = parse(source)
    kept = [m >= 0.5 for m in model.marginals(page)]
    if not any(kept[node] and text.strip() for _, node, text, _ in page.pieces):
        foreign = _foreign(page)
        kept = [not foreign[i] for i in range(len(kept))]
    lines, block, parts = [], -1, []
    for b, node, text, _ in page.pieces:
        if kept[node]:
            if b != block:
                lines.append("".join(parts))
                block, parts = b, []
            parts.append(text)
    lines.append("".join(parts))
    flat = (" ".join(line.split()) for line in lines)
    return "\n".join(line for line in flat if line)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Null or empty html gives empty text, as does a page without main text. A block is the text between two block-level tags; its
    white space is made one space and trimmed, and blocks are joined by a newline in page order. Character references are
    decoded. Repeated rows and null ids are each extracted; an empty table gives an empty table; other columns are ignored.
    """
    model = model or train(pages)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
