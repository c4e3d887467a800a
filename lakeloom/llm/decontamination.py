"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, ASCII lower-cased. All n-grams of a test item are its seeds, however common they are: the
ones that edited copies still hold may be the most common of the item. Around the places where a document holds seeds of an item
its words are compared to the item's. Each word of the item gives at most one match, so where too few of its words stand the
threshold is out of reach and nothing is aligned; all other places are aligned word by word (match 2, mismatch -1, gap -1). The
score is the best local alignment divided by that of the whole item with itself. Documents of `threshold` or more hold a copy,
exact or edited.

The test items are taken in blocks of BLOCK characters, so what is broadcast is bounded; every block meets all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkernel import ALNUM_ONLY, Lookup, shingle_hashes, text_slices, word_hashes

#: Characters of test items in a block (about 50 bytes of seeds each on every worker).
BLOCK = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long, passage string"


class Items:
    """A block of test items: their words' hashes and their n-grams."""

    def __init__(self, rows: list[tuple[int | None, str | None]], n: int):
        self.ids = [r[0] for r in rows]
        texts = pa.array([r[1] or "" for r in rows], pa.large_string())
        self.words: list[np.ndarray] = []
        for _, data, offsets in text_slices(texts):
            words, of, _, _ = word_hashes(data, offsets, ALNUM_ONLY)
            cuts = np.searchsorted(of, np.arange(len(offsets)))
            self.words += [words[cuts[i] : cuts[i + 1]] for i in range(len(offsets) - 1)]
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for i, words in enumerate(self.words):
            k = min(n, len(words))
            if k:
                grams = shingle_hashes(words, k)
                held[k].append((grams, np.full(len(grams), i, np.int32), np.arange(len(grams), dtype=np.int32)))
        #: By n-gram length: the hashes, where each one's entries start, and the entries' items and places. An item with fewer
        #: than n words is one n-gram of its own length.
        self.grams: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, parts in held.items():
            grams, items, places = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(grams, kind="stable")
            lookup = Lookup(grams)
            self.grams[k] = lookup, np.append(np.searchsorted(grams[order], lookup.keys), len(order)), items[order], places[order]

    def seeds(self, words: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(document, item, words at which the item would begin, ascending) of all documents that hold an n-gram of an item."""
        found = []
        for k, (lookup, starts, items, places) in self.grams.items():
            at, key = lookup.find(shingle_hashes(words, k))
            inside = of[at] == of[at + k - 1]
            at, key = at[inside], key[inside]
            n = starts[key + 1] - starts[key]
            entry = np.repeat(starts[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            found.append((of[at], items[entry], at - places[entry]))
        if not found:
            return
        d, i, begin = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((begin, i, d))
        d, i, begin = d[order], i[order], begin[order]
        firsts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]))) if len(d) else d
        for x, y in zip(firsts.tolist(), [*firsts[1:].tolist(), len(d)], strict=False):
            yield int(d[x]), int(i[x]), begin[x:y].tolist()


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, last word) of the best local alignment of item within words; (0, 0, 0) if nothing matches."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        ramp = np.arange(len(b) + 1, dtype=np.int64) * -GAP
        above, top = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i in range(len(a)):
            here = np.zeros(len(b) + 1, np.int64)
            np.maximum(above[:-1] + np.where(b == a[i], MATCH, MISMATCH), above[1:] + GAP, out=here[1:])
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + ramp) - ramp
            at = int(here.argmax())
            if here[at] > top[0]:
                top = (int(here[at]), i, at - 1)
            above = here
        return top

    score, row, last = best(item, words)
    if not score:
        return 0, 0, 0
    _, _, back = best(item[row::-1], words[last::-1])
    return score, last - back, last


def copies(column: pa.Array, items: Items, threshold: float) -> Iterator[tuple[int, int, float, int, int, str]]:
    """(row, item's number, score, first word, last word, passage) of each text in column and each item of which it holds a copy."""
    for first, data, offsets in text_slices(column):
        words, of, starts, ends = word_hashes(data, offsets, ALNUM_ONLY)
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        for d, i, begins in items.seeds(words, of):
            item, low, high = items.words[i], int(cuts[d]), int(cuts[d + 1])
            slack = 4 + len(item) // 3
            best, spans = (0, 0, 0), []
            for b in begins:
                x, y = max(low, b - slack), min(high, b + len(item) + slack)
                if spans and x <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], y)
                else:
                    spans.append([x, y])
            for x, y in spans:
                if np.isin(item, words[x:y]).sum() / len(item) < threshold:
                    continue
                score, a, z = align(item, words[x:y])
                if score > best[0]:
                    best = (score, x + a, x + z)
            share = best[0] / (MATCH * len(item))
            if share >= threshold:
                yield first + d, i, share, best[1] - low, best[2] - low, data[starts[best[1]] : ends[best[2]]].tobytes().decode(errors="replace")


def blocks(benchmark: DataFrame, n: int) -> Iterator[Items]:
    """The test items in blocks of BLOCK characters; one empty block if there are none."""
    block, held, any_ = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "")
        if held >= BLOCK:
            yield Items(block, n)
            block, held, any_ = [], 0, True
    if block or not any_:
        yield Items(block, n)


def find_copies(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, passage): each document with each test item of which it holds a copy.

    The place is that of the best-scoring copy (of equal ones the first), in words from 0. Null or wordless texts match nothing.
    Texts of any length are read whole. Repeated documents and repeated items each give rows. Null ids are returned as they are.
    With an empty table on either side the result is empty. Other columns are ignored. An item shorter than n words is found where all of it stands in a row.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def matched(items: Items) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0)
                out = [(names[row].as_py(), items.ids[i], *rest) for row, i, *rest in copies(batch.column(1), items, threshold)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word", "passage"])

        return source.mapInArrow(rows, SCHEMA)

    return reduce(DataFrame.unionByName, (matched(items) for items in blocks(benchmark, n)))


def without_copies(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text holds a copy of a test item.

    Each row is judged by its own text: of rows with one doc_id, null ones too, the clean ones stay. All columns stay as they are. Rows with null
    or wordless texts stay; with an empty benchmark all rows stay; an empty table gives an empty table.
    """
    at = [f.lower() for f in docs.schema.names].index("text")

    def kept(docs: DataFrame, items: Items) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in copies(batch.column(at).cast(pa.large_string()), items, threshold):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(rows, docs.schema)

    return reduce(kept, blocks(benchmark, n), docs)
