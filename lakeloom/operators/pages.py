"""Packed rows dealt out by their order: a task writes one compressed page of its rows for each range, and the task of a range sorts what is in its pages.

The bounds of the ranges are taken from a sample of rows before the rows themselves are packed, so these are read and packed once. All rows go to some
range; the sample decides only how even the ranges are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import batches
from ..sources.lake import COLUMNS_OF, LONG, Wide

_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Rows of a table in the sample, about, of one with short and one with long texts; bytes of a text of a bound.
SAMPLE, SAMPLE_LONG, BOUND_BYTES = 4096, 1024, 4096
#: Bytes of the cells of a range, about: CELL of each and its text. Small inputs have ranges of LEAST bytes for all cores.
RANGE, LEAST, CELL = 32 << 20, 2 << 20, 24
#: Packed rows, and their bytes, that a task deals out together.
DEAL, DEAL_BYTES = 1 << 20, 48 << 20
#: Of zstd, for pages.
LEVEL = 1
#: Cells, and bytes of their texts, of the batches that leave a range.
OUT, OUT_BYTES = 1 << 18, 4 << 20
_SAMPLED = "text binary, tableid long, colid long, piece long, weight double"
_PAGE = "part int, data binary"
_ROWS = ["tokenized", "tableid", "colid", "piece", "rows"]


def by_key(key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by four integers, and which rows differ in it from the one before."""
    spans = [(int(x.min()), int(x.max()) - int(x.min()) + 1) for x in key]
    if spans[0][1] * spans[1][1] * spans[2][1] * spans[3][1] < 1 << 62:
        one = np.zeros(len(key[0]), np.int64)
        for x, (least, span) in zip(key, spans, strict=True):
            one = one * span + (x - least)
        order = np.argsort(one)
        one = one[order]
        return order, one[1:] != one[:-1]
    order = np.lexsort(key[::-1])
    return order, np.any([x[order][1:] != x[order][:-1] for x in key], axis=0)


def _beginnings(texts: batches.Ragged) -> np.ndarray:
    """The first eight bytes of each text as one integer."""
    data, start, size = batches.runs(texts)
    out = np.zeros(len(size), np.uint64)
    data = np.append(data, np.uint8(0))
    for k in range(8):
        out = out << np.uint64(8) | np.where(size > k, data[np.minimum(start + k, len(data) - 1)], 0).astype(np.uint64)
    return out


class Bounds:
    """The least rows (text, tableid, colid, piece) of all ranges but the first."""

    def __init__(self, keys: list[tuple[bytes, int, int, int]]):
        self.keys = keys
        raw = [k[0] for k in keys]
        self.begins = _beginnings((np.frombuffer(b"".join(raw), np.uint8), batches.offsets_of(np.array([len(r) for r in raw], np.int64))))

    def parts(self, texts: pa.Array, ids: list[np.ndarray]) -> np.ndarray:
        """The range of each row."""
        held = _beginnings(batches.from_arrow(texts))
        low, high = np.searchsorted(self.begins, held), np.searchsorted(self.begins, held, "right")
        # only what begins like a bound is compared with it
        near = np.flatnonzero(low < high)
        for i, text in zip(near.tolist(), texts.take(pa.array(near)).cast(pa.binary()).to_pylist(), strict=True):
            low[i] = bisect_right(self.keys, (text, *[int(x[i]) for x in ids]), int(low[i]), int(high[i]))
        return low.astype(np.int32)


def _sampled(rows: _Step, share: float) -> _Step:
    def step(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in rows(frames):
            size = np.diff(batches.from_arrow(frame.column(0))[1])
            cells = np.diff(batches.from_arrow(frame.column(4))[1]) // 2
            texts = pc.binary_slice(frame.column(0).cast(pa.binary()), 0, BOUND_BYTES)
            yield pa.RecordBatch.from_arrays([texts, *frame.columns[1:4], pa.array(cells * (CELL + size) / share)], [c.split()[0] for c in _SAMPLED.split(", ")])

    return step


def counted(tables: list[Wide]) -> list[int]:
    """The rows of each table."""
    counts = dict(map(tuple, reduce(DataFrame.unionByName, [t.rows.select(F.lit(t.tableid).alias("t")) for t in tables]).groupBy("t").count().collect()))
    return [counts.get(t.tableid, 0) for t in tables]


def bounds_of(tables: list[Wide], counts: list[int], packing: Callable[[Wide], tuple[DataFrame, _Step]]) -> Bounds:
    """Ranges with about as many bytes of cells each."""
    found = []
    for t, n in zip(tables, counts, strict=True):
        share = min(1.0, (SAMPLE_LONG if t.name in LONG else SAMPLE) / max(1, n))
        if t.order:
            # any number may be a row's
            t = replace(t, rowid=F.rand(7) * n, order=())
        rows, step = packing(replace(t, rows=t.rows.sample(False, share, 7)) if share < 1 else t)
        found.append(rows.mapInArrow(_sampled(step, share), _SAMPLED))
    sample = reduce(DataFrame.unionByName, found).toArrow()
    grown = np.cumsum((sample := sample.take(pc.sort_indices(sample, [(c, "ascending") for c in ("text", "tableid", "colid", "piece")])))["weight"].to_numpy())
    total = float(grown[-1]) if len(grown) else 0.0
    n = max(1, -int(-total // RANGE), min(tables[0].rows.sparkSession.sparkContext.defaultParallelism, int(total // LEAST)))
    at = np.unique(np.searchsorted(grown, total * np.arange(1, n) / n))
    picked = sample.select(["text", "tableid", "colid", "piece"]).take(pa.array(at))
    return Bounds(sorted(set(zip(*[c.to_pylist() for c in picked.columns], strict=True))))


def _dealer(rows: _Step, bounds: Bounds) -> _Step:
    most, size = DEAL, DEAL_BYTES

    def step(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = chars = 0
        for frame in rows(frames):
            held.append(frame)
            n, chars = n + len(frame), chars + frame.nbytes
            if n >= most or chars >= size:
                yield pages(held)
                held, n, chars = [], 0, 0
        if n:
            yield pages(held)

    def pages(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = np.concatenate([bounds.parts(b.column(0), [c.to_numpy() for c in b.columns[1:4]]) for b in held])
        order = np.argsort(part, kind="stable")
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(5)], _ROWS).take(pa.array(order))
        heads = np.flatnonzero(np.diff(part[order], prepend=-1))
        data = [page(rows.slice(first, last - first)) for first, last in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[order[heads]], pa.int32()), pa.array(data, pa.binary())], [c.split()[0] for c in _PAGE.split(", ")])

    return step


def page(rows: pa.RecordBatch) -> bytes:
    """Packed rows as bytes: lengths instead of offsets, of rowids the steps, by low and high bytes."""
    (texts, ends), (places, cuts) = (batches.from_arrow(rows.column(i)) for i in (0, 4))
    steps = np.diff(places.view("<u2"), prepend=np.uint16(0)).view(np.uint8)
    held = [*[c.to_numpy() for c in rows.columns[1:4]], np.diff(ends).astype("<i4"), np.diff(cuts).astype("<i4")]
    raw = b"".join([np.array([len(rows), len(texts)], "<i8").tobytes(), *[x.tobytes() for x in held], steps[::2].tobytes(), steps[1::2].tobytes(), texts.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def unpage(data: bytes) -> pa.RecordBatch:
    raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    n, chars = raw[:16].view("<i8").tolist()
    held, at = [], 16
    for width in (8, 8, 8, 4, 4):
        held.append(raw[at : at + width * n].view(f"<i{width}"))
        at += width * n
    cells = (len(raw) - at - chars) // 2
    steps = np.stack([raw[at : at + cells], raw[at + cells : at + 2 * cells]], axis=1).reshape(-1).view("<u2")
    places = np.cumsum(steps, dtype=np.uint16).view(np.uint8)
    texts = batches.to_arrow((raw[len(raw) - chars :], batches.offsets_of(held[3])), pa.string())
    return pa.RecordBatch.from_arrays([texts, *map(pa.array, held[:3]), batches.to_arrow((places, batches.offsets_of(held[4])), pa.binary())], _ROWS)


def _gathered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the pages of one range, in order."""
    held = [unpage(data.as_py()) for frame in frames for data in frame.column(1)]
    if not held:
        return
    columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(5)]
    del held
    texts = columns[0].dictionary_encode()
    rank = np.zeros(len(texts.dictionary), np.int64)
    rank[pc.sort_indices(texts.dictionary).to_numpy()] = np.arange(len(rank))
    order, _ = by_key([rank[texts.indices.to_numpy()], *[c.to_numpy() for c in columns[1:4]]])
    size = np.diff(batches.from_arrow(columns[0])[1])[order]
    cells, grown = (np.cumsum(x) for x in (np.diff(batches.from_arrow(columns[4])[1])[order] // 2, size))
    rows, first = pa.RecordBatch.from_arrays(columns, _ROWS), 0
    while first < len(order):
        n, chars = (cells[first - 1], grown[first - 1]) if first else (0, 0)
        last = max(first + 1, min(int(np.searchsorted(cells, n + OUT, "right")), int(np.searchsorted(grown, chars + OUT_BYTES, "right"))))
        yield rows.take(pa.array(order[first:last]))
        first = last


def _key(columns: list[pa.Array]) -> list[np.ndarray]:
    """Columns as integers of the same order, nulls first; doubles as Spark has them: no number last, and one zero."""
    out = []
    for x in columns:
        none = x.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_floating(x.type):
            v = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
            v = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            v[np.isnan(x.fill_null(0).to_numpy(zero_copy_only=False))] = (1 << 63) - 1
        elif pa.types.is_string(x.type):
            held = x.fill_null("").dictionary_encode()
            rank = np.zeros(len(held.dictionary), np.int64)
            rank[pc.sort_indices(held.dictionary).to_numpy()] = np.arange(len(rank))
            v = rank[held.indices.to_numpy()]
        else:
            v = x.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        out += [~none, v] if none.any() else [v]
    return out


def _first_two(rows: pa.RecordBatch) -> np.ndarray:
    """Two integer columns as pairs, no value as the least."""
    found = np.zeros(len(rows), [("a", "<i8"), ("b", "<i8")])
    for c, x in zip("ab", rows.columns, strict=True):
        found[c] = x.fill_null(-1 << 63).to_numpy(zero_copy_only=False)
    return found


def _planes(x: pa.Array) -> pa.Array:
    """Values of 8 bytes with all first bytes before all second ones, which are alike; other columns as they are."""
    if pa.types.is_string(x.type):
        return x
    none = x.null_count and pa.py_buffer(np.packbits(x.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
    held = np.frombuffer(x.buffers()[1], np.uint8)[8 * x.offset : 8 * (x.offset + len(x))].reshape(-1, 8)
    return pa.Array.from_buffers(pa.binary(8), len(x), [none or None, pa.py_buffer(np.ascontiguousarray(held.T))])


def _whole(x: pa.Array, kind: pa.DataType) -> pa.Array:
    if pa.types.is_string(kind):
        return x
    valid, data = x.buffers()
    held = np.frombuffer(data, np.uint8)[: 8 * len(x)].reshape(8, -1)
    return pa.Array.from_buffers(kind, len(x), [valid, pa.py_buffer(np.ascontiguousarray(held.T))])


def _range_of(pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bounds are at or below each pair."""
    low, high = np.searchsorted(bounds["a"], pairs["a"]), np.searchsorted(bounds["a"], pairs["a"], "right")
    near = np.flatnonzero(low < high)
    if len(near):
        low[near] = np.searchsorted(bounds, pairs[near], "right")
    return low


def numbered(t: Wide, count: int, by_columns: Callable[[int, list[tuple[int, str]]], _Step]) -> tuple[DataFrame, _Step]:
    """Pages of the rows of a table that has no rowids, by ranges of its order, and the step that numbers the rows of a range and packs them.

    A range's first number is the count of the rows in those before it. The rows are counted and dealt by the same bounds.
    """
    forms, first, n_keys = t.forms, t.order[:2], len(t.order)
    # the first form of each column of the order, and of the others than the first two what the form leaves out
    form_of = [[i for i, *_ in forms].index(COLUMNS_OF[t.name].index(c)) for c in t.order]
    form_kinds = [forms[i][1] for i in form_of]
    left = [F.when(forms[i][2].isNull(), F.col(c).cast("timestamp_ntz") if k == "stamp" else F.col(c)) for c, i, k in zip(t.order, form_of, form_kinds, strict=True)][2:]
    rows = t.rows.select(*[x.alias(f"k{i}") for i, x in enumerate(left)], *[x.alias(f"f{i}") for i, (_, _, x) in enumerate(forms)])
    kinds = [to_arrow_type(f.dataType) for f in rows.schema]
    n_more, pair = len(left), [len(left) + i for i in form_of[:2]]
    pairs = t.rows.select(*[F.col(c).cast("long").alias(c) for c in first])
    sample = np.sort(_first_two(pairs.sample(False, min(1.0, SAMPLE / max(1, count)), 7).toArrow().combine_chunks().to_batches()[0])) if count else np.zeros(0, [("a", "<i8"), ("b", "<i8")])
    n = max(1, -(-count * len(forms) * (CELL + 8) // RANGE))
    bounds = np.unique(sample[len(sample) * np.arange(1, n) // n]) if len(sample) else sample

    def count_all(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(bounds) + 1, np.int64)
        for frame in frames:
            held += np.bincount(_range_of(_first_two(frame), bounds), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], ["part", "n"])

    held = np.zeros(len(bounds) + 1, np.int64)
    for r in pairs.mapInArrow(count_all, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        held[r.part] = r.n
    starts = np.cumsum(held) - held

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways, held, size = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL)), [], 0

        def pages() -> pa.RecordBatch:
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)], held[0].schema.names)
            part = _range_of(_first_two(whole.select(pair)), bounds)
            order = np.argsort(part, kind="stable")
            heads = np.flatnonzero(np.diff(part[order], prepend=-1))
            whole, data = whole.take(pa.array(order)), []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True):
                mine, out = pa.RecordBatch.from_arrays([_planes(c) for c in whole.slice(a, b - a).columns], whole.schema.names), pa.BufferOutputStream()
                with pa.ipc.new_stream(out, mine.schema, options=ways) as stream:
                    stream.write_batch(mine)
                data.append(out.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(part[order[heads]].astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])

        for frame in frames:
            held.append(frame)
            size += frame.nbytes
            if size >= DEAL_BYTES:
                yield pages()
                held, size = [], 0
        if size:
            yield pages()

    def gathered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], 0
        for frame in frames:
            for k, data in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                part = k
                for b in pa.ipc.open_stream(data.as_buffer()):
                    held.append([_whole(c, kind) for c, kind in zip(b.columns, kinds, strict=True)])
        if not held:
            return
        columns = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
        del held
        whole = pa.RecordBatch.from_arrays(columns[n_more:], [f"f{i}" for i in range(len(columns) - n_more)])
        order = np.lexsort(_key([ordered(c, columns) for c in range(n_keys)])[::-1])
        step = max(1, min(OUT // 8, int(len(order) * OUT_BYTES // max(1, whole.nbytes))))
        for a in range(0, len(order), step):
            mine = whole.take(pa.array(order[a : a + step]))
            yield pa.RecordBatch.from_arrays([pa.array(starts[part] + a + np.arange(len(mine))), *mine.columns], ["rowid", *mine.schema.names])

    def ordered(c: int, columns: list[pa.Array]) -> pa.Array:
        """A column of the order, from its form and what is not in that form."""
        form, more = columns[n_more + form_of[c]], columns[c - 2] if c > 1 else None
        if form_kinds[c] == "cents":
            return pc.coalesce(pa.array(form.to_numpy(zero_copy_only=False) / 100, from_pandas=True).cast(pa.float64()), more)
        if form_kinds[c] == "stamp":
            return pc.coalesce(form, more)
        return form

    packer = by_columns(t.tableid, [(i, kind) for i, kind, _ in forms])
    return rows.mapInArrow(deal, _PAGE).repartitionById(len(bounds) + 1, F.col("part")), lambda frames: packer(gathered(frames))


def dealt(tables: list[Wide], packing: Callable[[Wide], tuple[DataFrame, _Step]], by_columns: Callable[[int, list[tuple[int, str]]], _Step], then: _Step, schema: str) -> DataFrame:
    """`then` of the sorted packed rows of each range of all tables. packing: what Spark reads of a table, and the step from it to packed rows; by_columns:
    the step from the forms of a table's columns."""
    counts = counted(tables)
    bounds = bounds_of(tables, counts, packing)
    found = [numbered(t, n, by_columns) if t.order else packing(t) for t, n in zip(tables, counts, strict=True)]
    rows = reduce(DataFrame.unionByName, [df.mapInArrow(_dealer(step, bounds), _PAGE) for df, step in found])
    return rows.repartitionById(len(bounds.keys) + 1, F.col("part")).mapInArrow(lambda frames: then(_gathered(frames)), schema)
