"""Sizes of key blocks and posting lists of all layouts in one pass over cells that were sorted once.

The cells lie in bundles (encoded.py). Inside a bundle whole blocks and lists are sized where they lie; only those that go over the edge of a bundle,
at most two blocks and lists of each, are brought together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import batches, blocks as bytes_of
from ..sources.lake import Wide
from ..store import written
from .encoded import BUNDLE_BYTES, coded
from .index import PIECE
from .layouts import layout

#: The layout that cells are kept in meanwhile: plain keys, each once, and lists of any integers.
_BASE = "vbyte+ns+dedup"
#: what was sized, how many, their bytes; or a part of what goes over an edge.
_ROW = "what string, n long, bytes long, id long, pos long, piece long, key string, ints binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (coder, keys as runs of bytes, places where blocks begin, book) to bytes of all blocks; (coder, integers, sizes of lists) to bytes of all lists.
KeyBytes = Callable[[str, _Runs, np.ndarray, "bytes_of.ShortStrings | None"], int]
ListBytes = Callable[[str, np.ndarray, np.ndarray], int]


def key_bytes(how: str, keys: _Runs, firsts: np.ndarray, book: bytes_of.ShortStrings | None) -> int:
    """Counted from the bytes themselves."""
    return len(batches.encode_keys(batches.joined(keys), firsts, how, book)[0])


def list_bytes(how: str, ints: np.ndarray, sizes: np.ndarray) -> int:
    """Counted from the bytes themselves."""
    return len(batches.encode_postings(ints, sizes, how)[0])


def _ragged(texts: list[str]) -> batches.Ragged:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), batches.offsets_of(np.array([len(r) for r in raw], np.int64))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def tally(cells: DataFrame | list[Wide], names: list[str], book: bytes_of.ShortStrings | None = None, keys_by: KeyBytes = key_bytes, lists_by: ListBytes = list_bytes) -> DataFrame:
    """(what, n, bytes): for each way in which the layouts `names` store keys (keys/once/block: blocks) and postings (postings/once: payloads) their
    number and bytes; for `cells` and `keys` only a number."""
    ways = sorted({(x.keys, x.once, x.block) for x in map(layout, names)})
    codes = sorted({(x.postings, x.once) for x in map(layout, names)})
    bundles = written(coded(cells, _BASE, None).withColumn("bundle_id", F.monotonically_increasing_id()), large=True)
    heads = bundles.select("bundle_id", "first_key", "last_key", "n_keys", "n_cells")
    order = Window.orderBy("bundle_id")
    goes_on = (F.col("first_key") == F.lag("last_key").over(order)).cast("long")
    heads = heads.withColumn("before", F.coalesce(goes_on, F.lit(0)).cast("long")).withColumn("after", F.coalesce(F.lead("before").over(order), F.lit(0)))
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    # a key that goes on from the bundle before is counted there
    starts = heads.select("bundle_id", "before", "after", F.coalesce(F.sum("n_cells").over(lower), F.lit(0)).alias("cell_start"), F.coalesce(F.sum(F.col("n_keys") - F.col("before")).over(lower), F.lit(0)).alias("key_start"))

    def inside(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for data, cuts, places, postings, ends, before, after, cell_start, key_start in zip(*[c.to_pylist() for c in frame.columns], strict=True):
                keys = np.frombuffer(data, np.uint8), np.frombuffer(cuts, np.int64)
                ints, sizes = batches.decode_postings((np.frombuffer(postings, np.uint8), np.frombuffer(ends, np.int64)), layout(_BASE).postings)
                yield _rows(list(sized(keys, np.frombuffer(places, np.int64), ints, sizes, before, after, cell_start, key_start)))

    def sized(keys: batches.Ragged, places: np.ndarray, ints: np.ndarray, sizes: np.ndarray, before: int, after: int, cell_start: int, key_start: int) -> Iterator[tuple]:
        raw, start, size = batches.runs(keys)
        text = lambda i: raw[start[i] : start[i] + size[i]].tobytes().decode()
        own = np.arange(before, len(size))
        each = np.repeat(places, sizes // 3)
        yield "cells", len(each), None, None, None, None, None, None
        yield "keys", len(own), None, None, None, None, None, None
        for how, once, block in ways:
            what, chosen, first = f"{how}/{once}/{block}", own if once else each, key_start if once else cell_start
            width = max(1, block)
            skip = min(-first % width, len(chosen))
            whole = (len(chosen) - skip) // width * width
            grown = np.cumsum(size[chosen])
            at = skip
            while at < skip + whole:
                # texts that many cells hold are laid out in parts
                end = int(np.searchsorted(grown, (grown[at - 1] if at else 0) + BUNDLE_BYTES, "right"))
                end = min(skip + whole, at + max(1, (end - at) // width) * width)
                mine = chosen[at:end]
                yield what, (end - at) // width, keys_by(how, (raw, start[mine], size[mine]), np.arange(0, end - at, width), book), None, None, None, None, None
                at = end
            for i in [*range(skip), *range(skip + whole, len(chosen))]:
                yield what, None, None, (first + i) // width, first + i, None, text(chosen[i]), None
        edges = np.zeros(len(sizes), bool)
        if before:
            edges[0] = True
        if after:
            edges[-1] = True
        for how, once in codes:
            what, kept = f"{how}/{once}", np.repeat(~edges, sizes)
            if once:
                yield what, int((~edges).sum()), lists_by(how, ints[kept], sizes[~edges]), None, None, None, None, None
            else:
                yield what, len(each), lists_by(how, ints, np.full(len(each), 3)), None, None, None, None, None
        last = np.cumsum(sizes)
        for i in np.flatnonzero(edges).tolist():
            held = ints[last[i] - sizes[i] : last[i]]
            yield "list", None, None, int(held[0]), int(held[1]), int(held[2]) // PIECE, text(places[i]), held.tobytes()

    found = written(bundles.select("bundle_id", "keys", "blocks", "places", "payloads", "cuts").join(F.broadcast(starts), "bundle_id").drop("bundle_id").mapInArrow(inside, _ROW))

    def blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for what, texts in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                out.append((what, 1, keys_by(what.split("/")[0], batches.runs(_ragged([t["key"] for t in texts])), np.zeros(1, np.int64), book), *[None] * 5))
            yield _rows(out)

    def lists(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for parts in frame.column(0).to_pylist():
                ids = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 3)
                ids = ids[np.argsort(ids[:, 2], kind="stable")]
                out += [(f"{how}/True", 1, lists_by(how, ids.ravel(), np.array([ids.size])), *[None] * 5) for how, once in codes if once]
            yield _rows(out)

    over = found.where("pos IS NOT NULL AND what <> 'list'").groupBy("what", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("texts"))
    cut = found.where("what = 'list'").groupBy("key", "id", "pos", "piece").agg(F.collect_list("ints").alias("parts"))
    every = found.where("n IS NOT NULL").unionByName(over.select("what", "texts").mapInArrow(blocks, _ROW)).unionByName(cut.select("parts").mapInArrow(lists, _ROW))
    return every.groupBy("what").agg(F.sum("n").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def sizes(cells: DataFrame | list[Wide], names: list[str], **how: object) -> DataFrame:
    """(layout, cells, keys, blocks, payloads, key_bytes, posting_bytes) of layouts. Layouts that store keys or postings alike share one count."""
    found = written(tally(cells, names, **how))
    one = found.agg(F.coalesce(F.max(F.when(F.col("what") == "cells", F.col("n"))), F.lit(0)).alias("cells"), F.coalesce(F.max(F.when(F.col("what") == "keys", F.col("n"))), F.lit(0)).alias("once"))
    rows = [(n, x.once, f"{x.keys}/{x.once}/{x.block}", f"{x.postings}/{x.once}") for n, x in ((n, layout(n)) for n in names)]
    which = found.sparkSession.createDataFrame(rows, "layout string, one boolean, k string, p string")
    keyed = found.select(F.col("what").alias("k"), F.col("n").alias("blocks"), F.col("bytes").alias("key_bytes"))
    posted = found.select(F.col("what").alias("p"), F.col("n").alias("payloads"), F.col("bytes").alias("posting_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = which.join(keyed, "k", "left").join(posted, "p", "left").crossJoin(F.broadcast(one))
    return out.select("layout", "cells", F.when(F.col("one"), F.col("once")).otherwise(F.col("cells")).alias("keys"), *[zero(c) for c in ("blocks", "payloads", "key_bytes", "posting_bytes")])
