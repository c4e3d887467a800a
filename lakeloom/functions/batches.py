"""Many keys and posting lists to bytes and back at once with numpy; byte for byte what `blocks` makes of each.

Rows of different length are Ragged: their bytes one after the other, and offsets with one entry more than rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import blocks

Ragged = tuple[np.ndarray, np.ndarray]
#: Leading bytes that are compared for all pairs at once; what is longer is compared pair by pair.
_TOGETHER = 64
#: Groups of four values up to which lists are walked side by side.
_SIDE_BY_SIDE = 64
#: Blocks of 128 values that are coded at once.
_AT_ONCE = 512
#: Places of a stretch that is walked beside the others.
_STRIDE = 64
#: Bytes of the values behind a control byte of group varint, and the byte itself.
_GROUP = np.array([1 + sum((c >> 2 * i & 3) + 1 for i in range(4)) for c in range(256)], np.int64)


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def joined(*parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Ragged:
    """Row by row the runs (bytes, starts, sizes) of all parts, one after another."""
    offsets = offsets_of(sum(sizes for _, _, sizes in parts))
    out, at = np.zeros(int(offsets[-1]), np.uint8), offsets[:-1].copy()
    for data, starts, sizes in parts:
        out[spread(at, sizes)] = data[spread(starts, sizes)]
        at += sizes
    return out, offsets


def runs(rows: Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = rows
    return data, offsets[:-1], np.diff(offsets)


def from_arrow(column: pa.Array) -> Ragged:
    """The bytes of texts or binaries without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def to_arrow(rows: Ragged, kind: pa.DataType) -> pa.Array:
    """Texts or binaries of less than 2 GB."""
    data, offsets = rows
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# variable bytes


def varint_sizes(x: np.ndarray) -> np.ndarray:
    if len(x) and x.min() < 0:
        raise ValueError("a negative value")
    sizes = np.ones(len(x), np.int64)
    for bits in range(7, 63, 7):
        more = x >= 1 << bits
        if not more.any():
            break
        sizes += more
    return sizes


def varints(x: np.ndarray) -> Ragged:
    """One varint a row."""
    sizes = varint_sizes(x)
    offsets = offsets_of(sizes)
    out = np.zeros(int(offsets[-1]), np.uint8)
    for k in range(int(sizes.max()) if len(x) else 0):
        on = sizes > k
        out[offsets[:-1][on] + k] = (x[on] >> 7 * k & 127) | np.where(sizes[on] > k + 1, 128, 0)
    return out, offsets


def read_varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, and the places behind them."""
    x, at, on, shift = np.zeros(len(at), np.int64), at.copy(), np.arange(len(at)), 0
    while len(on):
        byte = data[at[on]].astype(np.int64)
        x[on] |= (byte & 127) << shift
        at[on] += 1
        on, shift = on[byte > 127], shift + 7
    return x, at


def _varint_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, last: bool) -> np.ndarray:
    """The first counts[i] varints of each run; last: the high bit marks a value's last byte instead of the others."""
    held = data[spread(starts, sizes)]
    ends = np.flatnonzero((held > 127) == last)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    begun = np.searchsorted(ends, firsts)
    ends_at = ends[spread(begun, counts)]
    heads = np.concatenate([[-1], ends])[spread(begun, counts)] + 1
    if len(heads):
        # the bytes before a run's first value belong to the run before
        some = counts > 0
        heads[(np.cumsum(counts) - counts)[some]] = firsts[some]
    x = np.zeros(len(heads), np.int64)
    for k in range(int((ends_at - heads).max()) + 1 if len(heads) else 0):
        on = heads + k <= ends_at
        x[on] |= (held[heads[on] + k].astype(np.int64) & 127) << 7 * k
    return x


def _summed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of x."""
    whole = offsets_of(x)
    ends = np.cumsum(sizes)
    return whole[ends] - whole[ends - sizes]


# group varint


def _fits(x: np.ndarray) -> None:
    if len(x) and (x.min() < 0 or x.max() >= 1 << 32):
        raise ValueError("a value outside 32 bits")


def grouped(x: np.ndarray, sizes: np.ndarray) -> Ragged:
    """Runs of x by group varint: a word with their number, before each four values a byte of widths, padded to words."""
    _fits(x)
    w = 1 + (x >= 1 << 8).astype(np.int64) + (x >= 1 << 16) + (x >= 1 << 24)
    offsets = offsets_of(-(-(4 + -(-sizes // 4) + _summed(w, sizes)) // 4) * 4)
    out, start = np.zeros(int(offsets[-1]), np.uint8), offsets[:-1]
    for k in range(4):
        out[start + k] = sizes >> 8 * k & 255
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(x)) - np.repeat(first, sizes)
    before = np.cumsum(w) - w
    at = np.repeat(start + 4 - np.append(before, 0)[first], sizes) + before + place // 4 + 1
    for k in range(4):
        on = w > k
        out[at[on] + k] = x[on] >> 8 * k & 255
    heads = np.flatnonzero(place % 4 == 0)
    if len(heads):
        out[at[heads] - 1] = np.bitwise_or.reduceat(w - 1 << 2 * (place % 4), heads)
    return out, offsets


def ungrouped(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of group varints that begin at `at`."""
    counts = sum(data[at + k].astype(np.int64) << 8 * k for k in range(4)) if len(at) else sizes
    if (counts != sizes).any():
        raise ValueError("the count differs")
    groups = -(-sizes // 4)
    first = np.cumsum(groups) - groups
    control = np.zeros(int(groups.sum()), np.int64)
    here, on, k = at + 4, np.flatnonzero((groups > 0) & (groups <= _SIDE_BY_SIDE)), 0
    while len(on):
        control[first[on] + k] = here[on]
        # the last group may be short: what stands behind it is not read
        here[on] += _GROUP[data[here[on]]]
        k += 1
        on = on[groups[on] > k]
    size = _GROUP.tolist()
    for i in np.flatnonzero(groups > _SIDE_BY_SIDE).tolist():
        p, found = 0, []
        held = data[at[i] + 4 : at[i] + 4 + 17 * groups[i]].tobytes()
        for _ in range(groups[i]):
            found.append(p)
            p += size[held[p]]
        control[first[i] : first[i] + groups[i]] = np.array(found, np.int64) + at[i] + 4
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group = np.repeat(first, sizes) + place // 4
    widths = data[control].astype(np.int64)[:, None] >> np.array([0, 2, 4, 6]) & 3
    inside = np.cumsum(widths + 1, axis=1) - widths - 1
    w, p = widths[group, place % 4] + 1, control[group] + 1 + inside[group, place % 4]
    x = np.zeros(len(p), np.int64)
    for k in range(4):
        on = w > k
        x[on] |= data[p[on] + k].astype(np.int64) << 8 * k
    return x


# posting lists


def _framed(rows: Ragged) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [runs(varints(np.diff(rows[1]))), runs(rows)]


def _marked(x: np.ndarray, sizes: np.ndarray) -> Ragged:
    """Runs of varints whose last bytes have the high bit, padded to words: what a block code leaves of less than a block."""
    data, offsets = varints(x)
    held = np.diff(offsets)
    size = _summed(held, sizes)
    begin = np.append(offsets[:-1], 0)[np.cumsum(sizes) - sizes] if len(x) else np.zeros(len(sizes), np.int64)
    return joined((data ^ 128, begin, size), (np.zeros(4, np.uint8), np.zeros(len(sizes), np.int64), -size % 4))


def _bits_of(x: np.ndarray, b: int) -> np.ndarray:
    """The low b bits of each value, the lowest first."""
    return np.unpackbits(x.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=b)


def _of_bits(rows: np.ndarray) -> np.ndarray:
    """The values of rows of bits, the lowest first."""
    wide = np.zeros((len(rows), 32), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def _few_blocks(v: np.ndarray, code: Callable[[np.ndarray], Ragged]) -> Ragged:
    """The rows of v coded some at a time, as each value becomes 32 bits of a byte."""
    parts = [code(v[i : i + _AT_ONCE]) for i in range(0, len(v), _AT_ONCE)]
    return np.concatenate([p[0] for p in parts]), offsets_of(np.concatenate([np.diff(p[1]) for p in parts]))


def _words(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4").view(np.uint8)


def fastpfor_blocks(v: np.ndarray) -> Ragged:
    """Each row of 128 values as a block of the codec simdfastpfor128."""
    if len(v) > _AT_ONCE:
        return _few_blocks(v, fastpfor_blocks)
    n = len(v)
    width = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    top = width.max(axis=1, initial=0)
    above = 128 - np.cumsum(np.bincount((np.arange(n)[:, None] * 33 + width).ravel(), minlength=33 * n).reshape(n, 33), axis=1)
    b = np.arange(33)
    cost = np.where(b < top[:, None], 8 * above + above * (top[:, None] - b) + 128 * b + 8, np.where(b == top[:, None], 128 * b, 1 << 40))
    # of equal costs the greatest width
    b = 32 - np.argmin(cost[:, ::-1], axis=1)
    count, high_width = above[np.arange(n), b], top - b
    low = [np.zeros(0, np.uint8)]
    for w in np.unique(b).tolist():
        mine = v[b == w]
        low.append(np.packbits(_bits_of(mine.ravel() & ((1 << w) - 1), w).ravel(), bitorder="little"))
    order = np.argsort(b, kind="stable")
    low_at = np.zeros(n, np.int64)
    low_at[order] = np.cumsum(16 * b[order]) - 16 * b[order]
    block, place = np.nonzero(width > b[:, None])
    places, high = place.astype(np.uint8), v[block, place] >> b[block]
    high_words = -(-count * high_width // 32)
    high_at = np.cumsum(4 * high_words) - 4 * high_words
    bits = np.zeros(32 * int(high_words.sum()), np.uint8)
    nth = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    for w in np.unique(high_width[block]).tolist():
        on = high_width[block] == w
        bits[(8 * high_at[block[on]] + nth[on] * w)[:, None] + np.arange(w)] = _bits_of(high[on], w)
    some = count > 0
    none, zero = np.zeros(n, np.int64), np.zeros(4, np.uint8)
    coded = np.where(some, -(-count // 4) + high_words + 1, 0)
    heads = _words(np.stack([b | count << 8, coded], axis=1).ravel())
    return joined(
        (heads, 8 * np.arange(n), none + 8),
        (np.concatenate(low), low_at, 16 * b),
        (places, np.cumsum(count) - count, count),
        (zero, none, -count % 4),
        (np.packbits(bits, bitorder="little"), high_at, 4 * high_words),
        (_words(high_width), 4 * np.arange(n), 4 * some),
    )


def un_fastpfor_blocks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of 128 values whose blocks begin at `at`."""
    if len(at) > _AT_ONCE:
        return np.concatenate([un_fastpfor_blocks(data, at[i : i + _AT_ONCE]) for i in range(0, len(at), _AT_ONCE)])
    word = lambda p: sum(data[p + k].astype(np.int64) << 8 * k for k in range(4))
    head = word(at)
    b, count, coded = head & 255, head >> 8, word(at + 4)
    v = np.zeros((len(at), 128), np.int64)
    for w in np.unique(b[b > 0]).tolist():
        on = np.flatnonzero(b == w)
        held = data[(at[on] + 8)[:, None] + np.arange(16 * w)]
        v[on] = _of_bits(np.unpackbits(held.ravel(), bitorder="little").reshape(-1, w)).reshape(-1, 128)
    block = np.repeat(np.arange(len(at)), count)
    begin = at + 8 + 16 * b
    place = data[spread(begin, count)]
    some = np.flatnonzero(count > 0)
    width = np.zeros(len(at), np.int64)
    width[some] = word(begin[some] + 4 * coded[some] - 4)
    begin, high = begin + -(-count // 4) * 4, np.zeros(len(block), np.int64)
    for w in np.unique(width[some]).tolist():
        on = some[width[some] == w]
        size = -(-count[on] * w // 32) * 4
        bits = np.unpackbits(data[spread(begin[on], size)], bitorder="little")
        high[width[block] == w] = _of_bits(bits[spread(8 * (np.cumsum(size) - size), count[on] * w)].reshape(-1, w))
    v[block, place] += high << b[block]
    return v


def _blocked(x: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of x by the codec simdfastpfor128: whole blocks, then varints."""
    whole = sizes // 128
    rest = np.repeat(np.cumsum(sizes) - sizes + 128 * whole, sizes) <= np.arange(len(x))
    data, offsets = fastpfor_blocks(x[~rest].reshape(-1, 128)) if whole.any() else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    first = np.cumsum(whole) - whole
    return [(data, offsets[first], offsets[first + whole] - offsets[first]), runs(_marked(x[rest], sizes - 128 * whole))]


def _unblocked(data: np.ndarray, at: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of runs that _blocked coded, which lie from `at` to `end`."""
    whole, at = sizes // 128, at.copy()
    if not whole.any():
        return _varint_runs(data, at, end - at, sizes, True)
    found = []
    for i in np.flatnonzero(whole).tolist():
        p, begin = 0, int(at[i])
        held = data[begin : end[i]].tobytes()
        for _ in range(int(whole[i])):
            found.append(begin + p)
            p += 8 + 16 * held[p] + 4 * int.from_bytes(held[p + 4 : p + 8], "little")
        at[i] += p
    x = np.zeros(int(sizes.sum()), np.int64)
    rest = np.repeat(np.cumsum(sizes) - sizes + 128 * whole, sizes) <= np.arange(len(x))
    x[~rest] = un_fastpfor_blocks(data, np.array(found, np.int64)).ravel()
    x[rest] = _varint_runs(data, at, end - at, sizes - 128 * whole, True)
    return x


def encode_postings(ints: np.ndarray, sizes: np.ndarray, how: str) -> Ragged:
    """Lists of sizes[i] integers (tableid, colid, rowid, ...) each as bytes; see blocks.encode_postings."""
    head = runs(varints(sizes))
    if how == "plain":
        _fits(ints)
        return joined(head, (ints.astype("<u4").view(np.uint8), 4 * (np.cumsum(sizes) - sizes), 4 * sizes))
    if how == "gve":
        return joined(head, runs(grouped(ints, sizes)))
    each = sizes // 3
    ids = ints.reshape(-1, 3)
    t, rest = ids[:, 0], ids[:, 1:].ravel()
    if how == "gve_split":
        steps = np.diff(t, prepend=0)
        some = np.flatnonzero(each > 0)
        first = (np.cumsum(each) - each)[some]
        steps[first] = t[first]
        return joined(head, *_framed(grouped(steps, each)), *_framed(grouped(rest, 2 * each)))
    if how == "vbyte":
        data, offsets = varints(rest)
        coded = (data, offsets[np.concatenate([[0], np.cumsum(2 * each)])])
        return joined(head, *_framed(coded), *_framed(grouped(t, each)))
    if how not in ("pfor", "pfor_split"):
        raise ValueError(f"no posting code {how!r}")
    _fits(ints)
    if how == "pfor":
        return joined(head, *_blocked(ints, sizes))
    return joined(head, *[p for i in range(3) for p in _framed(joined(*_blocked(ids[:, i], each)))])


def decode_postings(rows: Ragged, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(integers, list sizes) of payloads."""
    data, start, held = runs(rows)
    sizes, at = read_varints(data, start)
    if how == "plain":
        return data[spread(at, 4 * sizes)].view("<u4").astype(np.int64), sizes
    if how == "gve":
        return ungrouped(data, at, sizes), sizes
    each = sizes // 3
    out = np.zeros((int(each.sum()), 3), np.int64)
    if how in ("gve_split", "vbyte"):
        n, at = read_varints(data, at)
        _, then = read_varints(data, at + n)
        if how == "vbyte":
            out[:, 0], out[:, 1:] = ungrouped(data, then, each), _varint_runs(data, at, n, 2 * each, False).reshape(-1, 2)
        else:
            steps = ungrouped(data, at, each)
            whole = np.cumsum(steps)
            out[:, 0] = whole - np.repeat(np.append(whole - steps, 0)[np.cumsum(each) - each], each)
            out[:, 1:] = ungrouped(data, then, 2 * each).reshape(-1, 2)
        return out.ravel(), sizes
    if how not in ("pfor", "pfor_split"):
        raise ValueError(f"no posting code {how!r}")
    if how == "pfor":
        return _unblocked(data, at, start + held, sizes), sizes
    for i in range(3):
        n, at = read_varints(data, at)
        out[:, i] = _unblocked(data, at, at + n, each)
        at = at + n
    return out.ravel(), sizes


# keys


def shared(data: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Leading bytes in common of the runs at a and at b."""
    n = np.minimum(na, nb)
    out, on = n.copy(), np.flatnonzero(n > 0)
    for k in range(_TOGETHER):
        if not len(on):
            return out
        differ = data[a[on] + k] != data[b[on] + k]
        out[on[differ]] = k
        on = on[~differ]
        on = on[n[on] > k + 1]
    for i in on.tolist():
        differ = data[a[i] : a[i] + n[i]] != data[b[i] : b[i] + n[i]]
        k = int(differ.argmax())
        out[i] = k if differ[k] else n[i]
    return out


def encode_keys(keys: Ragged, firsts: np.ndarray, how: str, book: blocks.ShortStrings | None = None) -> Ragged:
    """Sorted keys in coded blocks that begin at `firsts`; plain and short keys are blocks of one."""
    data, start, size = runs(keys)
    if how == "plain":
        return keys
    if how == "short":
        return short(keys, book)
    if not len(firsts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    first = np.zeros(len(size), bool)
    first[firsts] = True
    if how == "front":
        last = np.append(firsts[1:], len(size)) - 1
        p = shared(data, start[firsts], size[firsts], start[last], size[last])
        each = np.repeat(p, np.diff(np.append(firsts, len(size))))
        rest, offsets = joined(runs(varints(size - each)), (data, start + each, size - each))
        begin = offsets[np.append(firsts, len(size))]
        return joined(runs(varints(p)), (data, start[firsts], p), (rest, begin[:-1], np.diff(begin)))
    before = np.maximum(np.arange(len(size)) - 1, 0)
    p = np.where(first, 0, shared(data, start[before], size[before], start, size))
    marks, at, n = runs(varints(p))
    rest, offsets = joined((marks, at, np.where(first, 0, n)), runs(varints(size - p)), (data, start + p, size - p))
    return rest, offsets[np.append(firsts, len(size))]


def decode_keys(coded: Ragged, how: str, book: blocks.ShortStrings | None = None) -> tuple[Ragged, np.ndarray]:
    """(keys, number of keys in each block)."""
    data, start, size = runs(coded)
    if how in ("plain", "short"):
        return coded if how == "plain" else unshort(coded, book), np.ones(len(size), np.int64)
    at, end, prefix = start.copy(), start + size, np.zeros(len(size), np.int64)
    if how == "front":
        prefix, at = read_varints(data, at)
        head = at
        at = at + prefix
    places, shares, begins, sizes = [], [], [], []
    on = np.flatnonzero(at < end)
    while len(on):
        p, here = (prefix[on], at[on]) if how == "front" or not places else read_varints(data, at[on])
        n, here = read_varints(data, here)
        places.append(on)
        shares.append(p)
        begins.append(here)
        sizes.append(n)
        at[on] = here + n
        on = on[at[on] < end[on]]
    if not places:
        return (np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(len(size), np.int64)
    counts = np.bincount(np.concatenate(places), minlength=len(size))
    first = np.cumsum(counts) - counts
    row = [first[on] + j for j, on in enumerate(places)]
    total = np.zeros(int(counts.sum()), np.int64)
    for r, p, n in zip(row, shares, sizes, strict=True):
        total[r] = p + n
    offsets = offsets_of(total)
    out = np.zeros(int(offsets[-1]), np.uint8)
    for r, on, p, b, n in zip(row, places, shares, begins, sizes, strict=True):
        # of a block's keys each one is whole before the next
        source, begin = (data, head[on]) if how == "front" else (out, offsets[np.maximum(r - 1, 0)])
        out[spread(offsets[r], p)] = source[spread(begin, p)]
        out[spread(offsets[r] + p, n)] = data[spread(b, n)]
    return (out, offsets), counts


def _chain(jump: np.ndarray, longest: int) -> np.ndarray:
    """Which places are reached from the first one, where jump leads from each to one at most `longest` ahead."""
    width, out = max(_STRIDE, longest), np.zeros(len(jump), bool)
    begins = np.arange(0, len(jump), width)
    ends = np.minimum(begins + width, len(jump))
    # from every place at which a stretch may be entered to the place behind it
    place, bound = (begins[:, None] + np.arange(longest)).ravel(), np.repeat(ends, longest)
    on = np.flatnonzero(place < bound)
    while len(on):
        place[on] = jump[place[on]]
        on = on[place[on] < bound[on]]
    entry, at = [], 0
    for left in (place.reshape(-1, longest) - ends[:, None]).tolist():
        entry.append(at)
        at = left[at]
    place = begins + np.array(entry, np.int64)
    place, bound = place[place < ends], ends[place < ends]
    while len(place):
        out[place] = True
        place = jump[place]
        place, bound = place[place < bound], bound[place < bound]
    return out


def _fragments(data: np.ndarray, left: np.ndarray, book: blocks.ShortStrings) -> tuple[np.ndarray, np.ndarray]:
    """At every place the code of the longest fragment that begins there and has at most left bytes (-1: none), and its length (1 where there is none)."""
    step, code = book.tree
    codes, length = np.full(len(data), -1), np.ones(len(data), np.int64)
    at, node, n = np.arange(len(data)), step[1].take(data), 1
    while len(at):
        held = code.take(node)
        hit = np.flatnonzero(held >= 0)
        codes[at[hit]], length[at[hit]] = held[hit], n
        on = np.flatnonzero((node > 0) & (left.take(at) > n))
        at, node = at[on], node[on]
        node = step[node, data.take(at + n)]
        at, node, n = at[node > 0], node[node > 0], n + 1
    return codes, length


def short(keys: Ragged, book: blocks.ShortStrings) -> Ragged:
    """Each key by fragments of a book, the longest first at every place."""
    data, start, size = runs(keys)
    if not len(data):
        return keys
    left = np.repeat(start + size, size) - np.arange(len(data))
    codes, length = _fragments(data, left, book)
    # fragments end with their key, so one chain goes through all keys
    taken = np.flatnonzero(_chain(np.arange(len(data)) + length, book.longest))
    code, begun = codes[taken], np.zeros(len(data), bool)
    begun[start[size > 0]] = True
    # bytes outside the book follow a mark, in parts of up to 256
    lost, place = code < 0, np.arange(len(taken))
    begins = lost & (begun[taken] | ~np.concatenate([[False], lost[:-1]]))
    part = lost & ((place - np.maximum.accumulate(np.where(begins, place, 0))) % 256 == 0)
    heads, edges = np.flatnonzero(part), np.append(np.flatnonzero(~lost | part), len(lost))
    many = edges[np.searchsorted(edges, heads, "right")] - heads
    sizes = np.ones(len(taken), np.int64)
    sizes[heads] += 1 + (many > 1)
    offsets = offsets_of(sizes)
    out = np.zeros(int(offsets[-1]), np.uint8)
    out[offsets[1:] - 1] = np.where(lost, data[taken], code)
    out[offsets[heads]] = np.where(many > 1, 255, 254)
    out[offsets[heads[many > 1]] + 1] = many[many > 1] - 1
    return out, offsets[np.searchsorted(taken, np.append(start, len(data)))]


def unshort(coded: Ragged, book: blocks.ShortStrings) -> Ragged:
    data, start, size = runs(coded)
    marks = np.flatnonzero(data > 253)
    # no text has such a byte, so one behind another is a count
    marks = marks[~np.isin(marks - 1, marks)]
    counted = data[marks] == 255
    more = np.ones(len(marks), np.int64)
    more[counted] += data[marks[counted] + 1]
    begin = marks + 1 + counted
    own = spread(begin, more)
    if (data[own] > 253).any():
        raw = [book.decode(data[a : a + n].tobytes()).encode() for a, n in zip(start, size, strict=True)]
        return np.frombuffer(b"".join(raw), np.uint8), offsets_of(np.array([len(r) for r in raw], np.int64))
    # fragments, then all single bytes, then nothing
    fragments = offsets_of(np.array([*map(len, book.book), *[1] * 256, 0], np.int64))
    which = data.astype(np.int64)
    which[own] += len(book.book)
    which[marks] = which[marks[counted] + 1] = len(book.book) + 256
    held = np.diff(fragments)[which]
    flat = np.frombuffer(b"".join(book.book) + bytes(range(256)), np.uint8)[spread(fragments[which], held)]
    return flat, offsets_of(held)[np.append(start, len(data))]
