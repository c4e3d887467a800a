"""Index layouts as real bytes: coded keys and postings in bundles that follow the order of cells, and lookups in them.

Cells are sorted once into Spark's ranges, and each range is coded as it comes out of the sort, without another shuffle. Before it the cells of a task
that share text, table, column and range of PIECE rows become one row, of 2 bytes a cell; they are put together again behind the sort. A bundle is a run of
cells: its keys in coded blocks, its payloads one after the other in a buffer, and of each payload the place of its key. It ends between two
blocks of keys where it can, so a key is stored again only where a range ends inside it or where one block of keys has more cells than a bundle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import batches, blocks as bytes_of
from ..ranges import latest, running
from ..sources.lake import LONG, Wide, cells_of
from ..store import dropped, written
from . import pages
from .index import PIECE
from .layouts import LAYOUTS, Layout, layout
from .order import CELL_ORDER

#: Keys from which a book of fragments is learned (those with the smallest hash).
BOOK_KEYS = 2_000
#: Bytes of a buffer at most, and of a payload for each of its cells.
ARENA, CELL_BYTES = 1 << 20, 32
#: Cells of a bundle, and bytes of their texts, after which it ends.
BUNDLE, BUNDLE_BYTES = 1 << 16, 2 << 20
#: Bundles that a lookup asks for, and runs of such one after another, up to which the reader leaves out the others.
ASKED, ASKED_RUNS = 10_000, 64
#: Cells, and bytes of their texts, among which a task looks for those that share a row.
PACK, PACK_BYTES = 1 << 17, 4 << 20
#: Bytes of whole rows among which a task does, column by column; of rows at most PACK.
WIDE_BYTES = 24 << 20
_PACKED = "tokenized string, tableid long, colid long, piece long, rows binary"
_PACKED_ORDER = ["tokenized", "tableid", "colid", "piece"]
_CELLS = "tokenized string, tableid long, colid long, rowid long"
_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Offsets of coded blocks in `keys`, of each payload the place of its key, offsets of payloads in `payloads`: integers of 8 bytes.
_BUNDLE = "first_key string, last_key string, n_keys long, n_cells long, blocks binary, keys binary, places binary, cuts binary, payloads binary"


@dataclass(frozen=True)
class Index:
    """bundles(bundle_id, first_key, last_key, n_keys, n_cells, blocks, keys, places, cuts, payloads), ordered by bundle_id."""

    name: str
    bundles: DataFrame
    book: bytes_of.ShortStrings | None

    @property
    def slices(self) -> DataFrame:
        """(arena_id, start, length) of every payload; start counts from the first buffer on."""

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for arena, base, cuts in zip(frame.arena_id, frame.base, frame.cuts, strict=True):
                    cuts = np.frombuffer(cuts, np.int64)
                    yield pd.DataFrame({"arena_id": arena, "start": base + cuts[:-1], "length": np.diff(cuts)})

        return self._based().select("arena_id", "base", "cuts").mapInPandas(rows, "arena_id long, start long, length long")

    @property
    def arenas(self) -> DataFrame:
        """(arena_id, base, data): the buffers of payloads."""
        return self._based().select("arena_id", "base", "data")

    def _based(self) -> DataFrame:
        held = self.bundles.select(F.col("bundle_id").alias("arena_id"), "cuts", F.col("payloads").alias("data"), F.octet_length("payloads").cast("long").alias("size"))
        return running(held, "arena_id", "size").withColumnRenamed("start", "base")

    def drop(self) -> None:
        """Deletes the table of the index."""
        dropped(self.bundles)


def learn_book(cells: DataFrame) -> bytes_of.ShortStrings:
    hashed = cells.select("tokenized", F.xxhash64("tokenized").alias("h"))
    # the least hash of each of many classes: those of that many keys, so the bound lies above enough of them, and only keys below it are dealt out
    least = hashed.groupBy(F.pmod("h", F.lit(32 * BOOK_KEYS)).alias("class")).agg(F.min("h").alias("h")).orderBy("h").limit(BOOK_KEYS).agg(F.count("h").alias("n"), F.max("h").alias("h")).first()
    if least.n == BOOK_KEYS:
        hashed = hashed.where(F.col("h") <= least.h)
    rows = hashed.distinct().orderBy("h", "tokenized").limit(BOOK_KEYS).collect()
    return bytes_of.ShortStrings.learned([r.tokenized for r in rows])


class _Bundler:
    """Sorted cells to bundles of a layout."""

    def __init__(self, x: Layout, book: bytes_of.ShortStrings | None, arena: int, full: int):
        self.x, self.book, self.arena, self.full = x, book, arena, full
        self.block = max(1, x.block)
        self.held: list[pa.RecordBatch] = []
        self.cells = self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Takes a batch, gives the bundles that are full."""
        at = batches.from_arrow(batch.column(0))[1]
        first = 0
        while first < len(at) - 1:
            # as many rows as fit, one at least
            room = min(first + self.full - self.cells, int(np.searchsorted(at, at[first] + BUNDLE_BYTES - self.bytes, "right")) - 1)
            last = min(len(at) - 1, max(room, first + 1))
            self.held.append(batch.slice(first, last - first))
            self.cells, self.bytes = self.cells + last - first, self.bytes + int(at[last] - at[first])
            first = last
            if self.cells >= self.full or self.bytes >= BUNDLE_BYTES or first < len(at) - 1:
                yield from self.flush(False)

    def flush(self, over: bool) -> Iterator[pa.RecordBatch]:
        if not self.cells:
            return
        columns = [pa.concat_arrays([b.column(i) for b in self.held]) for i in range(4)]
        keys, ids = batches.from_arrow(columns[0]), np.stack([c.to_numpy() for c in columns[1:]], axis=1)
        new = changes(columns[0]) if self.x.once else np.ones(len(ids), bool)
        heads = np.flatnonzero(new)
        end = len(ids)
        if not over and len(heads) > self.block:
            # the block of keys that the next cells may go on with stays
            end = int(heads[(len(heads) - 1) // self.block * self.block])
        heads = heads[heads < end]
        rest = [c.slice(end) for c in columns]
        self.held = [pa.RecordBatch.from_arrays(rest, ["tokenized", *CELL_ORDER[1:]])] if len(rest[0]) else []
        self.cells, self.bytes = len(rest[0]), int(keys[1][-1] - keys[1][end])
        for first, last in self._buffers(heads, end):
            mine = heads[np.searchsorted(heads, first, "right") - 1 : np.searchsorted(heads, last)]
            yield self._bundle(columns[0], keys, ids, np.maximum(mine, first), first, last)

    def _buffers(self, heads: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
        """The parts of cells whose payloads fill one buffer each; one where the layout has no buffers. No code takes more than CELL_BYTES a cell."""
        step = max(1, self.arena // CELL_BYTES) if self.x.arena else end
        first = 0
        while first < end:
            last = min(end, first + step)
            # between two blocks of keys where there is one
            cut = heads[:: self.block]
            cut = cut[(cut > first) & (cut <= last)]
            last = int(cut[-1]) if len(cut) and last < end else last
            yield first, last
            first = last

    def _bundle(self, texts: pa.Array, keys: batches.Ragged, ids: np.ndarray, heads: np.ndarray, first: int, last: int) -> pa.RecordBatch:
        ids = ids[first:last]
        data, start, size = batches.runs(keys)
        own = batches.joined((data, start[heads], size[heads]))
        place = np.zeros(last - first, np.int64)
        place[heads - first] = 1
        place = np.cumsum(place) - 1
        coded = batches.encode_keys(own, np.arange(0, len(heads), self.block), self.x.keys, self.book)
        begins = np.arange(last - first)
        if self.x.once:
            run = np.stack([place, ids[:, 0], ids[:, 1], ids[:, 2] // PIECE], axis=1)
            begins = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]).any(axis=1)]))
        payloads, cuts = batches.encode_postings(ids.ravel(), 3 * np.diff(np.append(begins, last - first)), self.x.postings)
        raw = [coded[1], coded[0], place[begins], cuts, payloads]
        values = [texts[first].as_py(), texts[last - 1].as_py(), len(heads), last - first, *[x.tobytes() for x in raw]]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _BUNDLE.split(", ")])


def changes(keys: pa.Array) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    if not len(keys):
        return np.zeros(0, bool)
    return np.concatenate([[True], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)])


def packed(cells: DataFrame) -> DataFrame:
    """(tokenized, tableid, colid, piece, rows): cells of a task with one text, table, column and rowid // PIECE in one row; rows: their rowid % PIECE,
    2 bytes each, not sorted."""
    return cells.select(*CELL_ORDER).mapInArrow(_packer(), _PACKED)


def _packer() -> _Step:
    most, size = PACK, PACK_BYTES

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = chars = 0
        for frame in frames:
            held.append(frame)
            n, chars = n + len(frame), chars + frame.column(0).nbytes
            if n >= most or chars >= size:
                yield _pack(held)
                held, n, chars = [], 0, 0
        if n:
            yield _pack(held)

    return rows


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    texts = pa.concat_arrays([b.column(0) for b in held]).dictionary_encode()
    t, c, r = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2, 3))
    key = [texts.indices.to_numpy().astype(np.int64), t, c, r // PIECE]
    order, new = pages.by_key(key)
    heads = np.flatnonzero(np.concatenate([[True], new]))
    first = order[heads]
    places = batches.to_arrow(((r % PIECE)[order].astype("<u2").view(np.uint8), 2 * np.append(heads, len(t))), pa.binary())
    columns = [texts.dictionary.take(pa.array(key[0][first])), *[pa.array(x[first]) for x in key[1:]], places]
    return pa.RecordBatch.from_arrays(columns, [*_PACKED_ORDER, "rows"])


def packed_tables(tables: list[Wide]) -> DataFrame:
    """packed() of the cells of tables. The columns of short texts are packed one by one, from rows that were not made cells before."""
    return reduce(DataFrame.unionByName, [rows.mapInArrow(step, _PACKED) for rows, step in map(packing, tables)])


def packing(table: Wide) -> tuple[DataFrame, _Step]:
    """What Spark reads of a table, and the step from it to packed rows."""
    if table.name in LONG:
        return table.cells.select(*CELL_ORDER), _packer()
    rows, forms = table.typed
    return rows, _column_packer(table.tableid, forms)


def _column_packer(tableid: int, forms: list[tuple[int, str]]) -> _Step:
    most, size = PACK, WIDE_BYTES

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = chars = 0
        for frame in frames:
            held.append(frame)
            n, chars = n + len(frame), chars + frame.nbytes
            if n >= most or chars >= size:
                yield from columns(held)
                held, n, chars = [], 0, 0
        if n:
            yield from columns(held)

    def columns(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.concatenate([b.column(0).to_numpy() for b in held])
        for i, (colid, kind) in enumerate(forms, 1):
            values, own = pa.concat_arrays([b.column(i) for b in held]), r
            if values.null_count:
                values, own = values.drop_null(), r[values.is_valid().to_numpy(zero_copy_only=False)]
            if len(values):
                yield _pack_column(values, kind, tableid, colid, own)

    return rows


def as_texts(values: pa.Array, kind: str) -> pa.Array:
    """Values of a form of lake.forms() as text."""
    if kind == "text":
        return values
    if kind == "long":
        return values.cast(pa.string())
    if kind == "stamp":
        # of the six digits of a second none at the end is a zero
        return pc.utf8_rtrim(pc.utf8_rtrim(values.cast(pa.timestamp("us")).cast(pa.string()), "0"), ".")
    x = values.to_numpy()
    whole, part = np.divmod(np.abs(x), 100)
    sign, ends = pa.array(["", "-"]).take(pa.array((x < 0).astype(np.int8))), pa.array([f".{i:02d}" for i in range(100)])
    return pc.binary_join_element_wise(sign, pa.array(whole).cast(pa.string()), ends.take(pa.array(part)), "")


def _pack_column(values: pa.Array, kind: str, tableid: int, colid: int, r: np.ndarray) -> pa.RecordBatch:
    """The cells of one form of a column, those of one text and rowid // PIECE in one row."""
    held, piece = values.dictionary_encode(), r // PIECE
    texts = as_texts(held.dictionary, kind)
    n, heads, order = len(r), np.arange(len(r)), slice(None)
    if len(held.dictionary) < n:
        code, least = held.indices.to_numpy().astype(np.int64), int(piece.min())
        span, shift = int(piece.max()) - least + 1, n.bit_length()
        if len(held.dictionary) * span < 1 << 62 - shift:
            # by text and piece, and the place in the low bits
            one = np.sort((code * span + (piece - least)) << shift | heads)
            order, one = one & (1 << shift) - 1, one >> shift
            new = one[1:] != one[:-1]
        else:
            order = np.lexsort([piece, code])
            new = (code[order][1:] != code[order][:-1]) | (piece[order][1:] != piece[order][:-1])
        heads = np.flatnonzero(np.concatenate([[True], new]))
        texts, piece = texts.take(pa.array(code[order[heads]])), piece[order[heads]]
    places = batches.to_arrow(((r % PIECE)[order].astype("<u2").view(np.uint8), 2 * np.append(heads, n)), pa.binary())
    return pa.RecordBatch.from_arrays([texts, *[pa.array(np.full(len(heads), x)) for x in (tableid, colid)], pa.array(piece), places], [*_PACKED_ORDER, "rows"])


def _unpacked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of sorted packed rows, in order."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(rest.columns, frame.columns, strict=True)], rest.schema.names)
        heads = _heads(frame)
        if len(heads):
            # the next rows may go on with the last text and piece
            yield from _expanded(frame.slice(0, int(heads[-1])), heads[:-1])
            rest = frame.slice(int(heads[-1]))
    if rest is not None:
        yield from _expanded(rest, np.zeros(1, np.int64))


def _heads(frame: pa.RecordBatch) -> np.ndarray:
    new = changes(frame.column(0))
    for i in (1, 2, 3):
        ids = frame.column(i).to_numpy()
        new[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new)


def _expanded(frame: pa.RecordBatch, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(heads):
        return
    data, offsets = batches.from_arrow(frame.column(4))
    group = np.repeat(np.arange(len(heads)), np.diff(offsets[np.append(heads, len(frame))]) // 2)
    # by group, then by row
    cells = group * PIECE + data.view("<u2")
    cells.sort()
    group = cells // PIECE
    at = heads[group]
    t, c, piece = (frame.column(i).to_numpy()[at] for i in (1, 2, 3))
    ids = [t, c, piece * PIECE + cells % PIECE]
    texts = frame.column(0)
    grown, first = np.cumsum(np.diff(batches.from_arrow(texts)[1])[at]), 0
    while first < len(at):
        # one long text may stand in many cells
        last = max(first + 1, int(np.searchsorted(grown, (grown[first - 1] if first else 0) + BUNDLE_BYTES, "right")))
        yield pa.RecordBatch.from_arrays([texts.take(pa.array(at[first:last])), *[pa.array(x[first:last]) for x in ids]], CELL_ORDER)
        first = last


def _coder(name: str, book: bytes_of.ShortStrings | None) -> _Step:
    """Sorted packed rows to bundles of a layout."""
    x, arena, full = layout(name), ARENA, BUNDLE

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Bundler(x, book, arena, full)
        for frame in _unpacked(frames):
            yield from held.add(frame)
        yield from held.flush(True)

    return rows


def _placed(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(*_PACKED_ORDER).sortWithinPartitions(*_PACKED_ORDER)


def coded(cells: DataFrame | list[Wide], name: str, book: bytes_of.ShortStrings | None) -> DataFrame:
    """The bundles of a layout, in the order of cells. The rows of tables are packed column by column and dealt out in pages."""
    if isinstance(cells, list):
        return pages.dealt(cells, packing, _column_packer, _coder(name, book), _BUNDLE)
    return _placed(packed(cells)).mapInArrow(_coder(name, book), _BUNDLE)


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _decoded(keys: batches.Ragged, places: np.ndarray, payloads: batches.Ragged, how: str) -> Iterator[pa.RecordBatch]:
    """The cells of payloads, whose keys stand at `places`."""
    ints, sizes = batches.decode_postings(payloads, how)
    ids, key = ints.reshape(-1, 3), np.repeat(places, sizes // 3)
    texts = batches.to_arrow(keys, pa.string())
    grown = np.cumsum(np.diff(keys[1])[key])
    first = 0
    while first < len(key):
        # one key may stand in many cells: rows go out by their bytes
        last = max(first + 1, int(np.searchsorted(grown, (grown[first - 1] if first else 0) + BUNDLE_BYTES, "right")))
        yield pa.RecordBatch.from_arrays([texts.take(pa.array(key[first:last])), *[pa.array(np.ascontiguousarray(ids[first:last, i])) for i in range(3)]], CELL_ORDER)
        first = last


def _reader(name: str, book: bytes_of.ShortStrings | None) -> _Step:
    """Bundles to all of their cells, from the bytes."""
    x = layout(name)

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for blocks, keys, places, cuts, payloads in zip(*[frame.column(c).to_pylist() for c in ("blocks", "keys", "places", "cuts", "payloads")], strict=True):
                texts, _ = batches.decode_keys((np.frombuffer(keys, np.uint8), _ints(blocks)), x.keys, book)
                yield from _decoded(texts, _ints(places), (np.frombuffer(payloads, np.uint8), _ints(cuts)), x.postings)

    return rows


def _book(cells: DataFrame | list[Wide], name: str) -> bytes_of.ShortStrings | None:
    return learn_book(cells_of(cells) if isinstance(cells, list) else cells) if layout(name).keys == "short" else None


def build(cells: DataFrame | list[Wide], name: str, keep: bool = False) -> Index:
    """The index of a layout, written, so that lookups read bytes; keep: its caller drops it."""
    book = _book(cells, name)
    return Index(name, written(coded(cells, name, book).withColumn("bundle_id", F.monotonically_increasing_id()), large=True), book)


def round_trip(cells: DataFrame, name: str) -> DataFrame:
    """The cells after a layout's keys and postings were made bytes and read back; texts come from the coded keys only."""
    book = _book(cells, name)
    code, read = _coder(name, book), _reader(name, book)
    # a bundle is read as soon as its bytes are there
    return _placed(packed(cells)).mapInArrow(lambda frames: read(code(frames)), _CELLS)


def round_trip_tables(tables: list[Wide], name: str) -> DataFrame:
    """round_trip() of the cells of tables, whose packed rows are dealt out in pages."""
    book = _book(tables, name)
    code, read = _coder(name, book), _reader(name, book)
    return pages.dealt(tables, packing, _column_packer, lambda frames: read(code(frames)), _CELLS)


def candidates(index: Index, probes: DataFrame) -> DataFrame:
    """(key, bundle_id) of the bundles that may hold each of probes(key): the last one that begins below it and all that begin with it."""
    wanted = probes.select("key").distinct()
    heads = index.bundles.select(F.col("first_key").alias("key"), F.col("bundle_id").alias("blk"), F.lit(1).alias("flag"))
    mixed = heads.unionByName(wanted.select("key", F.lit(None).cast("long").alias("blk"), F.lit(0).alias("flag")))
    below = latest(mixed, ["key", "flag", "blk"], "blk", "bundle_id").where("flag = 0 AND bundle_id IS NOT NULL").select("key", "bundle_id")
    return below.unionByName(wanted.join(heads, "key").select("key", F.col("blk").alias("bundle_id")))


def lookup(index: Index, probes: DataFrame) -> DataFrame:
    """Cells of probes(key). Probes are compared with coded keys (plain and short keys), or with the keys of the only blocks that may hold them; only the
    payloads found are decoded."""
    x, book = layout(index.name), index.book
    # written, so that its size is known before the join: where few bundles are asked for, the others are not dealt out
    asked = written(candidates(index, probes).groupBy("bundle_id").agg(F.collect_set("key").alias("probes")))
    held = _only(index.bundles, asked).select("bundle_id", "blocks", "keys", "places", "cuts", "payloads").join(asked, "bundle_id").drop("bundle_id")

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for blocks, keys, places, cuts, payloads, probes in zip(*[c.to_pylist() for c in frame.columns], strict=True):
                found, texts = _found(keys, _ints(blocks), probes, x, book)
                places, (data, start, size) = _ints(places), batches.runs((np.frombuffer(payloads, np.uint8), _ints(cuts)))
                mine = np.flatnonzero(np.isin(places, found))
                if len(mine):
                    raw = [texts[i].encode() for i in found.tolist()]
                    own = np.frombuffer(b"".join(raw), np.uint8), batches.offsets_of(np.array([len(r) for r in raw], np.int64))
                    yield from _decoded(own, np.searchsorted(found, places[mine]), batches.joined((data, start[mine], size[mine])), x.postings)

    return held.mapInArrow(rows, _CELLS)


def _only(bundles: DataFrame, asked: DataFrame) -> DataFrame:
    """bundles without row groups that hold none of those asked for, where these are not many; what else is left, the join drops."""
    ids = sorted(r.bundle_id for r in asked.select("bundle_id").limit(ASKED + 1).collect())
    firsts = [i for i, x in enumerate(ids) if not i or ids[i - 1] + 1 < x]
    if not ids or len(ids) > ASKED or len(firsts) > ASKED_RUNS:
        return bundles
    runs = [F.col("bundle_id").between(ids[a], ids[b - 1]) for a, b in zip(firsts, [*firsts[1:], len(ids)], strict=True)]
    return bundles.where(reduce(Column.__or__, runs))


def _found(keys: bytes, cuts: np.ndarray, probes: list[str], x: Layout, book: bytes_of.ShortStrings | None) -> tuple[np.ndarray, dict[int, str]]:
    """Places of a bundle's keys that are among the probes, in order, and their texts."""
    if not x.block:
        wanted = {(p.encode() if x.keys == "plain" else book.encode(p)): p for p in probes}
        near = np.flatnonzero(np.isin(np.diff(cuts), [len(w) for w in wanted])).tolist()
        texts = {i: wanted[k] for i in near if (k := keys[cuts[i] : cuts[i + 1]]) in wanted}
        return np.array(list(texts), np.int64), texts
    first_of = lambda i: _block(keys[cuts[i] : cuts[i + 1]], x.keys)[0].encode()
    texts = {}
    for probe in probes:
        raw, low, high = probe.encode(), 0, len(cuts) - 1
        while low < high:  # the first block that begins with the probe or after it; the one before may hold it too
            middle = (low + high) // 2
            low, high = (middle + 1, high) if first_of(middle) < raw else (low, middle)
        for i in range(max(0, low - 1), len(cuts) - 1):
            held = _block(keys[cuts[i] : cuts[i + 1]], x.keys)
            if held[0].encode() > raw:
                break
            texts |= {i * x.block + j: k for j, k in enumerate(held) if k == probe}
    return np.array(sorted(texts), np.int64), texts


def _block(data: bytes, how: str) -> list[str]:
    return bytes_of.unfront(data) if how == "front" else bytes_of.unincremental(data)


def real_sizes(cells: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(layout, cells, keys, blocks, payloads, key_bytes, posting_bytes), counted from the bytes themselves. Blocks of keys are those of the whole order, lists
    those of whole pieces."""
    from .tally import sizes

    names = list(LAYOUTS) if names is None else names
    return sizes(cells, names, book=learn_book(cells) if any(layout(n).keys == "short" for n in names) else None)
