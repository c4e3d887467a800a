"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the words that a text holds; each model also sees the
probabilities that the chain gave for the categories before it. In training these are out-of-fold predictions, so a later model
learns from probabilities as it will meet them. Words are runs of letters, ASCII lower-cased; they and their beginnings are
features, weighted by their log-odds in the training rows. The model is fitted on a bounded sample of labelled rows (`most_rows`, those with the smallest hash of their id)
and has `most_words` words at most; scoring reads all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkernel import LETTERS_ONLY, text_slices, word_beginnings

#: Categories in the chain's order, as SQL over labels(toxic, quality); the first one decides on rejection.
CATEGORIES = {"toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 and quality = 0"}
#: Besides a whole word its first so many bytes are features, so inflected and compound forms count.
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 3
PENALTY = 0.5


def word_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of words and their beginnings of every text; null counts as empty."""
    for _, data, offsets in text_slices(column):
        words, of = word_beginnings(data, offsets, LETTERS_ONLY, BEGINNINGS)
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield np.unique(words[cuts[i] : cuts[i + 1]])


def minimised(loss, start: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving. loss(x) gives value and gradient."""
    x, (value, slope) = start, loss(start)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < 1e-5:
            break
        q, kept = slope.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        size = 1.0 if steps else 1.0 / max(1.0, np.abs(slope).sum())
        for _ in range(30):
            new = x - size * q
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1.0 / (s @ y))]
        x, value, slope = new, new_value, new_slope
    return x


@dataclass
class Rows:
    """Training rows: the places of their words in the vocabulary, row after row."""

    words: np.ndarray
    cuts: np.ndarray

    def sums(self, weights: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(weights[self.words])])
        return upto[self.cuts[1:]] - upto[self.cuts[:-1]]

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.words, np.repeat(values, np.diff(self.cuts)), minlength=size)

    def where(self, keep: np.ndarray) -> Rows:
        lengths = np.diff(self.cuts)
        return Rows(self.words[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(lengths[keep])]))


@dataclass
class Link:
    """One category's model: a weight for each word, for each earlier category, and a bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def chance(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums + earlier @ self.earlier + self.bias, -500, 500)))


def fitted(rows: Rows, earlier: np.ndarray, wanted: np.ndarray, size: int) -> Link:
    """A penalised logistic model; a word's value is its smoothed log-odds, so words that tell nothing stay near 0."""
    n, m = len(wanted), earlier.shape[1]
    if not n or wanted.all() or not wanted.any():
        rate = (wanted.sum() + 0.5) / (n + 2)  # below a half without rows
        return Link(np.zeros(size), np.zeros(m), float(np.log(rate / (1 - rate))))
    yes, no = rows.back(wanted * 1.0, size) + 1, rows.back(1.0 - wanted, size) + 1
    odds = np.log(yes / yes.sum() * no.sum() / no)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, e, b = x[:size], x[size : size + m], x[-1]
        z = rows.sums(w * odds) + earlier @ e + b
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - wanted
        value = np.logaddexp(0, np.where(wanted, -z, z)).sum() + PENALTY * (w @ w + e @ e) / 2
        return float(value), np.concatenate([rows.back(off, size) * odds + PENALTY * w, earlier.T @ off + PENALTY * e, [off.sum()]])

    x = minimised(loss, np.zeros(size + m + 1))
    return Link(x[:size] * odds, x[size : size + m], float(x[-1]))


def chain(rows: Rows, wanted: np.ndarray, folds: np.ndarray, size: int) -> tuple[list[Link], np.ndarray]:
    """The links in order, and the out-of-fold probabilities. wanted: rows by categories."""
    n, categories = wanted.shape
    out = np.zeros((n, 0))
    links = []
    for j in range(categories):
        links.append(fitted(rows, out, wanted[:, j], size))
        held = np.zeros(n)
        for f in range(FOLDS):
            here = folds == f
            if here.any():
                link = fitted(rows.where(~here), out[~here], wanted[~here, j], size)
                held[here] = link.chance(rows.where(here).sums(link.words), out[here])
        out = np.column_stack([out, held])
    return links, out


@dataclass
class Chain:
    """A trained chain: sorted word hashes, and for each category a link."""

    names: list[str]
    keys: np.ndarray
    links: list[Link]

    def chances(self, texts: pa.Array) -> np.ndarray:
        places, cuts = [], [0]
        for words in word_rows(texts):
            at = np.minimum(np.searchsorted(self.keys, words), max(0, len(self.keys) - 1))
            at = at[self.keys[at] == words] if len(self.keys) else at[:0]
            places.append(at)
            cuts.append(cuts[-1] + len(at))
        rows = Rows(np.concatenate(places) if places else np.zeros(0, np.int64), np.array(cuts))
        out = np.zeros((len(cuts) - 1, 0))
        for link in self.links:
            out = np.column_stack([out, link.chance(rows.sums(link.words), out)])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, most_rows: int = 2_000, most_words: int = 32_768, least_rows: int = 3) -> Chain:
    """A chain fitted on most_rows labelled documents at most. Labels that name no document, or with a null, are not used; of
    several labels of a document the greater toxic and the lesser quality hold; of several texts with one id that with the least hash."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).where("toxic is not null and quality is not null")
    marks = marks.select("label_id", F.xxhash64("label_id").alias("h"), *[F.expr(sql).cast("int").alias(f"y{j}") for j, sql in enumerate(categories.values())])
    ids = docs.select(F.col("doc_id").cast("long").alias("label_id")).distinct()
    chosen = marks.join(ids, "label_id", "left_semi").orderBy("h", "label_id").limit(most_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.view(np.int64) for w in word_rows(batch.column(0))]
            cuts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            flat = np.concatenate(words) if words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int64()))], [*batch.schema.names[1:], "words"])

    names = [f"y{j}" for j in range(len(categories))]
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    held = texts.join(F.broadcast(chosen), "label_id").select("text", "h", "label_id", *names, F.xxhash64("text").alias("t"))
    # repeated documents would leave the bound: one row for each label, that of the text with the least hash
    held = held.mapInArrow(rows, ", ".join(["h long", "label_id long", *[f"{n} int" for n in names], "t long", "words array<long>"]))
    held = held.groupBy("label_id").agg(F.min_by(F.struct("h", *names, "words"), "t").alias("x")).select("label_id", "x.*")
    got = held.toArrow().sort_by([("h", "ascending"), ("label_id", "ascending")])
    words = got.column("words").combine_chunks()
    flat, cuts = words.values.to_numpy().view(np.uint64), words.offsets.to_numpy().astype(np.int64)
    flat, cuts = flat[cuts[0] : cuts[-1]] if len(cuts) > 1 else flat[:0], cuts - cuts[0]
    wanted = np.column_stack([got.column(n).to_numpy().astype(bool) for n in names])
    h = got.column("h").to_numpy().astype(np.uint64)
    keys, places, counts = np.unique(flat, return_inverse=True, return_counts=True)
    places = places.astype(np.int32)
    del got, words, flat
    # the words that say most about any category, most_words of them
    lengths = np.diff(cuts)
    worth = np.zeros(len(keys))
    for j in range(len(names)):
        yes = np.bincount(places, np.repeat(wanted[:, j], lengths), minlength=len(keys)) + 1
        no = counts + 2 - yes
        worth = np.maximum(worth, np.abs(np.log(yes / no) - np.log((wanted[:, j].sum() + 1) / ((~wanted[:, j]).sum() + 1))) * np.sqrt(counts))
    worth[counts < least_rows] = -1
    best = np.argsort(-worth, kind="stable")[:most_words]
    best = np.sort(best[worth[best] >= 0])
    where = np.full(len(keys), -1, np.int32)
    where[best] = np.arange(len(best))
    new = where[places]
    at = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    rows_ = Rows(new[new >= 0], np.concatenate([[0], np.cumsum(np.bincount(at[new >= 0], minlength=len(lengths)))]))
    keys = keys[best]
    del places, new, at, where, worth
    folds = (h >> np.uint64(7)) % np.uint64(FOLDS)
    links, _ = chain(rows_, wanted, folds, len(best))
    return Chain(list(categories), keys, links)


def score(docs: DataFrame, model: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category> for each category, rejected) of every row of docs(doc_id, text).

    rejected: the first category's probability is threshold or more. Null text counts as empty; an empty text gets the models'
    bias; repeated rows and null ids are each scored; an empty table gives an empty table; other columns are ignored. A model without
    labelled rows rejects nothing. Texts of any length are scored whole.
    """
    names = [f"p_{n}" for n in model.names]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.chances(batch.column(1))
            columns = [pa.array(p[:, j]) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(p[:, 0] >= threshold)], ["doc_id", *names, "rejected"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, ", ".join(["doc_id long", *[f"{n} double" for n in names], "rejected boolean"]))


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, threshold: float = 0.5) -> DataFrame:
    """Trains the chain on labels(doc_id, toxic, quality) and scores docs."""
    return score(docs, train(docs, labels, categories), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the chain rejects, each judged by its own text; all columns stay as they are. Edges as in score."""
    model = train(docs, labels)
    schema = docs.schema
    at = [f.lower() for f in schema.names].index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.chances(batch.column(at).cast(pa.large_string()))[:, 0] < threshold))

    return docs.mapInArrow(rows, schema)
