"""Integer codecs that produce real 32-bit words: arrays of values below 2^32 to words, and back.

Layouts are this library's own; the rules by which widths and selectors are chosen are the published ones of each scheme.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Words = np.ndarray


def bits(v: np.ndarray) -> np.ndarray:
    """Bit widths; 0 for 0."""
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack(v: np.ndarray, b: int) -> Words:
    """Values below 2^b side by side, the first in the lowest bits; padded to whole words."""
    if b == 0 or not len(v):
        return np.zeros(0, np.uint32)
    flat = ((v.astype(np.uint64)[:, None] >> np.arange(b, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    flat = np.pad(flat, (0, -len(flat) % 32))
    return np.packbits(flat, bitorder="little").view(np.uint32)


def unpack(words: Words, b: int, n: int) -> np.ndarray:
    if b == 0 or n == 0:
        return np.zeros(n, np.int64)
    flat = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")[: n * b].reshape(n, b)
    return (flat.astype(np.int64) << np.arange(b, dtype=np.int64)).sum(axis=1)


def packed_words(n: int, b: int) -> int:
    return -(-n * b // 32)


def as_words(data: bytes, pad: bytes = b"\0") -> Words:
    return np.frombuffer(data + pad * (-len(data) % 4), np.uint32)


@dataclass(frozen=True)
class Codec:
    """block: the array's length must be a multiple; encode gives words, decode takes (words, n) and gives (values, words used)."""

    encode: Callable[[np.ndarray], Words]
    decode: Callable[[Words, int], tuple[np.ndarray, int]]
    block: int = 1


# byte codecs


def _varint(v: np.ndarray, last: bool) -> Words:
    out = bytearray()
    for x in v.tolist():
        parts = []
        while True:
            parts.append(x & 127)
            x >>= 7
            if not x:
                break
        for i, p in enumerate(parts):
            out.append(p | 128 if (i == len(parts) - 1) == last else p)
    return as_words(bytes(out), b"\0" if last else b"\xff")


def _unvarint(words: Words, n: int, last: bool) -> tuple[np.ndarray, int]:
    data, out, at = words.tobytes(), [], 0
    for _ in range(n):
        x = shift = 0
        while True:
            byte = data[at]
            at += 1
            x |= (byte & 127) << shift
            shift += 7
            if bool(byte & 128) == last:
                break
        out.append(x)
    return np.array(out, np.int64), -(-at // 4)


def _byte_widths(v: np.ndarray) -> np.ndarray:
    return 1 + (v >= 1 << 8).astype(np.int64) + (v >= 1 << 16) + (v >= 1 << 24)


def _grouped(v: np.ndarray, apart: bool) -> Words:
    """Count word, 2-bit widths of each four values, and the values' bytes; all widths first (apart) or before each four."""
    widths = _byte_widths(v)
    keys = pack(widths - 1, 2).view(np.uint8)[: -(-len(v) // 4)]
    data = [int(x).to_bytes(int(w), "little") for x, w in zip(v, widths, strict=True)]
    if apart:
        body = keys.tobytes() + b"".join(data)
    else:
        body = b"".join(bytes([keys[i]]) + b"".join(data[4 * i : 4 * i + 4]) for i in range(len(keys)))
    return as_words(len(v).to_bytes(4, "little") + body)


def _ungrouped(words: Words, n: int, apart: bool) -> tuple[np.ndarray, int]:
    data = words.tobytes()
    count, control = int.from_bytes(data[:4], "little"), -(-n // 4)
    if count != n:
        raise ValueError("the count differs")
    out, at = [], 4 + control if apart else 4
    key = 0
    for i in range(n):
        if i % 4 == 0:
            key = data[4 + i // 4] if apart else data[at]
            at += not apart
        w = ((key >> 2 * (i % 4)) & 3) + 1
        out.append(int.from_bytes(data[at : at + w], "little"))
        at += w
    return np.array(out, np.int64), -(-at // 4)


def _g8iu(v: np.ndarray) -> Words:
    """Groups of a descriptor and 8 bytes; a bit of the descriptor is 0 where a value's last byte lies, unused bytes have 1."""
    out, group, mask = bytearray(), bytearray(), 0
    for x, w in zip(v.tolist(), _byte_widths(v).tolist(), strict=True):
        if len(group) + w > 8:
            mask |= 255 << len(group) & 255
            out += bytes([mask]) + group.ljust(8, b"\0")
            group, mask = bytearray(), 0
        mask |= ((1 << w - 1) - 1) << len(group)
        group += x.to_bytes(w, "little")
    if group:
        mask |= 255 << len(group) & 255
        out += bytes([mask]) + group.ljust(8, b"\0")
    return as_words(bytes(out))


def _ung8iu(words: Words, n: int) -> tuple[np.ndarray, int]:
    data, out, at = words.tobytes(), [], 0
    while len(out) < n:
        mask, x, shift = data[at], 0, 0
        for i in range(8):
            x |= data[at + 1 + i] << shift
            shift += 8
            if not mask >> i & 1:
                out.append(x)
                x = shift = 0
        at += 9
    return np.array(out, np.int64), -(-at // 4)


# block packing


def _binary(mini: int, group: int) -> Codec:
    """Blocks of `group` mini blocks, each packed by its greatest width; one byte a width."""

    def encode(v: np.ndarray) -> Words:
        out = [np.array([len(v)], np.uint32)]
        for block in v.reshape(-1, mini * group):
            minis = block.reshape(group, mini)
            widths = bits(minis.max(axis=1))
            out += [as_words(widths.astype(np.uint8).tobytes()), *[pack(m, int(b)) for m, b in zip(minis, widths, strict=True)]]
        return np.concatenate(out)

    def decode(words: Words, n: int) -> tuple[np.ndarray, int]:
        out, at = [], 1
        for _ in range(n // (mini * group)):
            head = -(-group // 4)
            widths = words[at : at + head].view(np.uint8)[:group].tolist()
            at += head
            for b in widths:
                used = packed_words(mini, b)
                out.append(unpack(words[at : at + used], b, mini))
                at += used
        return np.concatenate([*out, np.zeros(0, np.int64)]), at

    return Codec(encode, decode, mini * group)


def _exceptions_above(v: np.ndarray) -> list[int]:
    """For each width 0 to 32 the number of wider values."""
    counts = np.bincount(bits(v), minlength=33)
    return (len(v) - np.cumsum(counts)).tolist()


def _least(costs: list[tuple[float, int]]) -> int:
    """The b of least cost; of equal costs the greatest b."""
    return min(costs, key=lambda x: (x[0], -x[1]))[1]


def fastpfor_width(v: np.ndarray, scalar: bool, head: int = 8) -> int:
    above, n = _exceptions_above(v), len(v)
    top = int(bits(v).max())
    costs = [(top * n, top)]
    for b in range(top):
        e = above[b]
        costs.append((8 * e + e * (top - b) + b * n + head - (e if scalar and top - b == 1 else 0), b))
    return _least(costs)


def newpfor_widths(v: np.ndarray) -> list[int]:
    top = int(bits(v).max())
    return [b for b in [*range(14), 16, 20, 32] if top <= 28 + b]


def newpfor_width(v: np.ndarray) -> int:
    above = _exceptions_above(v)
    return next((b for b in newpfor_widths(v) if 10 * above[b] <= len(v)), 32)


def optpfor_width(v: np.ndarray) -> int:
    """The candidate of least true size; of equal sizes the greatest."""
    return _least([(len(_patched(v, b, "simple16")), b) for b in newpfor_widths(v)])


def pfor_width(v: np.ndarray) -> int:
    """One width for an array's first 65,536 values; of equal costs the least."""
    v = v[:65_536]
    above, best = _exceptions_above(v), (32.0, 32)
    for b in range(31, -1, -1):
        rate = above[b] / len(v)
        if above[b]:
            rate = max(rate, (rate * 128 - 1) / (rate * (1 << b)))
        best = min(best, (b + 32 * rate, b))
    return best[1]


def _patched(v: np.ndarray, b: int, how: str) -> Words:
    """A block's low bits by width b; of exceptions the places and high bits, coded by `how`."""
    at = np.flatnonzero(bits(v) > b) if b < 32 else np.zeros(0, np.int64)
    high = v[at] >> b
    if how in ("simple16", "simple8b"):
        extra = np.concatenate([np.diff(at, prepend=-1) - 1, high]) if len(at) else high
        coded = WORD_CODERS[how].encode(extra)
    else:
        w = int(bits(high).max()) if len(high) else 0
        w = {"bits": w, "sizes": next(s for s in (8, 16, 32) if w <= s)}[how]
        coded = np.concatenate([as_words(at.astype(np.uint8).tobytes()), pack(high, w), np.array([w], np.uint32)]) if len(at) else np.zeros(0, np.uint32)
    head = np.array([b | len(at) << 8, len(coded)], np.uint32)
    return np.concatenate([head, pack(v & ((1 << b) - 1) if b < 32 else v, b), coded])


def _unpatched(words: Words, n: int, how: str) -> tuple[np.ndarray, int]:
    b, count, size = int(words[0]) & 255, int(words[0]) >> 8, int(words[1])
    low = packed_words(n, b)
    v, coded = unpack(words[2 : 2 + low], b, n), words[2 + low : 2 + low + size]
    if count:
        if how in ("simple16", "simple8b"):
            extra, _ = WORD_CODERS[how].decode(coded, 2 * count)
            at, high = np.cumsum(extra[:count] + 1) - 1, extra[count:]
        else:
            heads = -(-count // 4)
            w = int(coded[-1])
            at, high = coded[:heads].view(np.uint8)[:count].astype(np.int64), unpack(coded[heads:-1], w, count)
        v[at] += high << b
    return v, 2 + low + size


def _patching(block: int, how: str, width: Callable[[np.ndarray], int]) -> Codec:
    def encode(v: np.ndarray) -> Words:
        return np.concatenate([np.zeros(0, np.uint32), *[_patched(x, width(x), how) for x in v.reshape(-1, block)]])

    def decode(words: Words, n: int) -> tuple[np.ndarray, int]:
        out, at = [np.zeros(0, np.int64)], 0
        for _ in range(n // block):
            v, used = _unpatched(words[at:], block, how)
            out.append(v)
            at += used
        return np.concatenate(out), at

    return Codec(encode, decode, block)


def _linked(sized: bool) -> Codec:
    """One width for the array; in each block of 128 the exceptions' places form a chain through the packed slots, with further
    exceptions where a link would not fit; exceptions stand whole (or by the least of 8, 16, 32 bits) after the block."""

    def encode(v: np.ndarray) -> Words:
        if not len(v):
            return np.zeros(0, np.uint32)
        b = pfor_width(v)
        out = [np.array([b], np.uint32)]
        for block in v.reshape(-1, 128):
            wanted = np.flatnonzero(bits(block) > b).tolist() if b < 32 else []
            chain: list[int] = []
            for p in wanted:
                while chain and p - chain[-1] > 1 << b:
                    chain.append(chain[-1] + (1 << b))
                chain.append(p)
            slots = block.copy()
            for p, q in zip(chain, [*chain[1:], None], strict=False):
                slots[p] = q - p - 1 if q is not None else 0
            held = block[chain]
            w = next(s for s in (8, 16, 32) if not len(held) or bits(held).max() <= s) if sized else 32
            first = chain[0] if chain else 255
            out += [np.array([first | len(chain) << 8 | w << 16], np.uint32), pack(slots, b), pack(held, w)]
        return np.concatenate(out)

    def decode(words: Words, n: int) -> tuple[np.ndarray, int]:
        out, at = [np.zeros(0, np.int64)], 1 if n else 0
        b = int(words[0]) if n else 0
        for _ in range(n // 128):
            p, count, w = int(words[at]) & 255, int(words[at]) >> 8 & 255, int(words[at]) >> 16
            low, more = packed_words(128, b), packed_words(count, w)
            v = unpack(words[at + 1 : at + 1 + low], b, 128)
            for x in unpack(words[at + 1 + low : at + 1 + low + more], w, count).tolist():
                link = p + int(v[p]) + 1
                v[p] = x
                p = link
            out.append(v)
            at += 1 + low + more
        return np.concatenate(out), at

    return Codec(encode, decode, 128)


# word codecs: the first pattern of widths that holds the next values

_SIMPLE9 = [[1] * 28, [2] * 14, [3] * 9, [4] * 7, [5] * 5, [7] * 4, [9] * 3, [14] * 2, [28]]
_SIMPLE16 = [
    [1] * 28, [2] * 7 + [1] * 14, [1] * 7 + [2] * 7 + [1] * 7, [1] * 14 + [2] * 7, [2] * 14, [4] + [3] * 8, [3] + [4] * 4 + [3] * 3, [4] * 7,
    [5] * 4 + [4] * 2, [4] * 2 + [5] * 4, [6] * 3 + [5] * 2, [5] * 2 + [6] * 3, [7] * 4, [10] + [9] * 2, [14] * 2, [28],
]
_SIMPLE8B = [[0] * 240, [0] * 120, *[[w] * (60 // w) for w in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]]


def _selecting(patterns: list[list[int]], payload: int, size: int, run: bool = False) -> Codec:
    """size: bytes of a word; the selector stands in the 4 bits above the payload. run: a run of equal values of `payload` bits
    or more in all takes one word (selector 15: 28 bits of length above 32 of value)."""
    patterns = patterns[: 15 if run else 16]
    shifts = [np.cumsum([0, *p[:-1]]) for p in patterns]

    def encode(v: np.ndarray) -> Words:
        out, at, n = bytearray(), 0, len(v)
        w = bits(v)
        if n and w.max() > max(p[0] for p in patterns):
            raise ValueError(f"values of {w.max()} bits are too wide")
        limits = [np.array(p) for p in patterns]
        values = v.tolist()
        while at < n:
            if run:
                length = 1
                while at + length < n and values[at + length] == values[at] and length < (1 << 28) - 1:
                    length += 1
                if max(1, int(w[at])) * length >= payload:
                    out += (15 << 60 | length << 32 | values[at]).to_bytes(8, "little")
                    at += length
                    continue
            for s, limit in enumerate(limits):
                m = min(len(limit), n - at)
                # zeros-only words stand for a full count
                if limit[0] == 0 and m < len(limit):
                    continue
                if (w[at : at + m] <= limit[:m]).all():
                    word = s << payload
                    for x, k in zip(values[at : at + m], shifts[s].tolist(), strict=False):
                        word |= x << k
                    out += word.to_bytes(size, "little")
                    at += m
                    break
        return as_words(bytes(out))

    def decode(words: Words, n: int) -> tuple[np.ndarray, int]:
        data, out, at = words.tobytes(), [], 0
        while len(out) < n:
            word = int.from_bytes(data[at : at + size], "little")
            at += size
            s = word >> payload
            if run and s == 15:
                out += [word & 0xFFFFFFFF] * (word >> 32 & (1 << 28) - 1)
                continue
            out += [word >> int(k) & (1 << b) - 1 for b, k in zip(patterns[s], shifts[s], strict=True)]
        return np.array(out[:n], np.int64), -(-at // 4)

    return Codec(encode, decode)


def _simple9_wide() -> Codec:
    """Simple9 whose single value has 31 bits: the top bit marks it, three bits select otherwise."""
    patterns = _SIMPLE9[:8]

    def encode(v: np.ndarray) -> Words:
        out, at, values, w = [], 0, v.tolist(), bits(v)
        if len(v) and w.max() > 31:
            raise ValueError("values of 32 bits are too wide")
        while at < len(values):
            for s, p in enumerate(patterns):
                m = min(len(p), len(values) - at)
                if (w[at : at + m] <= p[0]).all():
                    out.append(s << 28 | sum(x << p[0] * i for i, x in enumerate(values[at : at + m])))
                    at += m
                    break
            else:
                out.append(1 << 31 | values[at])
                at += 1
        return np.array(out, np.uint32)

    def decode(words: Words, n: int) -> tuple[np.ndarray, int]:
        out, at = [], 0
        while len(out) < n:
            word = int(words[at])
            at += 1
            if word >> 31:
                out.append(word & (1 << 31) - 1)
            else:
                p = patterns[word >> 28]
                out += [word >> p[0] * i & (1 << p[0]) - 1 for i in range(len(p))]
        return np.array(out[:n], np.int64), at

    return Codec(encode, decode)


WORD_CODERS = {
    "simple9": _selecting(_SIMPLE9, 28, 4),
    "simple9_rle": _simple9_wide(),
    "simple16": _selecting(_SIMPLE16, 28, 4),
    "simple8b": _selecting(_SIMPLE8B, 60, 8),
    "simple8b_rle": _selecting(_SIMPLE8B[2:], 60, 8, run=True),
}

_LANES = [(32, 1), (16, 2), (10, 3), (8, 4), (6, 5), (5, 6), (4, 8), (3, 10), (2, 16), (1, 32)]


def _group_simple(v: np.ndarray, gap: bool = False) -> Words:
    """Fours of values share a width, that of all four or-ed; each lane's word holds as many fours as a selector allows. gap: the words of
    the selectors are as many as one for each four would take, so that lanes can be written before the selectors are known."""
    quads = v.reshape(-1, 4)
    w = bits(np.bitwise_or.reduce(quads, axis=1)) if len(quads) else np.zeros(0, np.int64)
    selectors, lanes, at = [], [], 0
    while at < len(quads):
        for s, (count, b) in enumerate(_LANES):
            m = min(count, len(quads) - at)
            if (w[at : at + m] <= b).all():
                selectors.append(s)
                lanes += [sum(int(x) << b * i for i, x in enumerate(quads[at : at + m, lane])) for lane in range(4)]
                at += m
                break
    head = pack(np.array(selectors, np.int64), 4)
    spare = packed_words(len(quads), 4) - len(head) if gap else 0
    return np.concatenate([np.array([len(selectors)], np.uint32), head, np.zeros(spare, np.uint32), np.array(lanes, np.uint32)])


def _ungroup_simple(words: Words, n: int, gap: bool = False) -> tuple[np.ndarray, int]:
    count = int(words[0])
    head = packed_words(n // 4 if gap else count, 4)
    out, at, left = [np.zeros((0, 4), np.int64)], 1 + head, n // 4
    for s in unpack(words[1 : 1 + packed_words(count, 4)], 4, count).tolist():
        c, b = _LANES[s]
        m = min(c, left)
        out.append(np.array([[int(words[at + lane]) >> b * i & (1 << b) - 1 for lane in range(4)] for i in range(m)], np.int64).reshape(m, 4))
        at += 4
        left -= m
    return np.concatenate(out).ravel(), at


# fixed values: lengths of runs, lengths of runs of zeros, and the widths that a run may have
VS_RUNS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
VS_ZERO_RUNS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 32)
VS_WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 20, 32)
#: Bits of a run's head: its length and its width, by number.
VS_HEAD = 8


def vs_partition(w: list[int]) -> list[tuple[int, int]]:
    """(length, width) of the runs that take the fewest bits in all, for values of widths w: a shortest path over the places between them."""
    n = len(w)
    cost, cut = [0] + [1 << 60] * n, [(0, 0)] * (n + 1)
    rounded = [VS_WIDTHS[bisect_left(VS_WIDTHS, x)] for x in range(33)]
    for i in range(n):
        top, so_far = 0, cost[i] + VS_HEAD
        for length in range(1, min(VS_ZERO_RUNS[-1], n - i) + 1):
            top = max(top, w[i + length - 1])
            if top and length > VS_RUNS[-1]:
                break
            b = rounded[top]
            if (c := so_far + length * b) < cost[i + length] and length in (VS_RUNS if top else VS_ZERO_RUNS):
                cost[i + length], cut[i + length] = c, (length, b)
    out, at = [], n
    while at:
        out.append(cut[at])
        at -= cut[at][0]
    return out[::-1]


def _vs(v: np.ndarray) -> Words:
    heads, body, at = [], [np.zeros(0, np.uint8)], 0
    for length, b in vs_partition(bits(v).tolist()):
        heads.append((VS_RUNS if b else VS_ZERO_RUNS).index(length) | VS_WIDTHS.index(b) << 4)
        body.append(((v[at : at + length, None] >> np.arange(b)) & 1).astype(np.uint8).ravel())
        at += length
    flat = np.concatenate(body)
    packed = np.packbits(np.pad(flat, (0, -len(flat) % 32)), bitorder="little").view(np.uint32)
    return np.concatenate([np.array([len(heads)], np.uint32), pack(np.array(heads, np.int64), VS_HEAD), packed])


def _unvs(words: Words, n: int) -> tuple[np.ndarray, int]:
    count = int(words[0])
    head = packed_words(count, VS_HEAD)
    flat = np.unpackbits(np.ascontiguousarray(words[1 + head :]).view(np.uint8), bitorder="little")
    out, at = [np.zeros(0, np.int64)], 0
    for h in unpack(words[1 : 1 + head], VS_HEAD, count).tolist():
        b = VS_WIDTHS[h >> 4]
        length = (VS_RUNS if b else VS_ZERO_RUNS)[h & 15]
        out.append((flat[at : at + length * b].reshape(length, b).astype(np.int64) << np.arange(b)).sum(axis=1))
        at += length * b
    return np.concatenate(out), 1 + head + packed_words(at, 1)


def composed(first: Codec) -> Codec:
    """Whole blocks by `first`, the rest by varint."""

    def encode(v: np.ndarray) -> Words:
        cut = len(v) // first.block * first.block
        return np.concatenate([first.encode(v[:cut]) if cut else np.zeros(0, np.uint32), _varint(v[cut:], True)])

    def decode(words: Words, n: int) -> tuple[np.ndarray, int]:
        cut = n // first.block * first.block
        head, used = first.decode(words, cut) if cut else (np.zeros(0, np.int64), 0)
        tail, more = _unvarint(words[used:], n - cut, True)
        return np.concatenate([head, tail]), used + more

    return Codec(encode, decode)


def _snappy(v: np.ndarray) -> Words:
    """The values' bytes under the general-purpose byte compressor, behind a word with their number."""
    data = pa.Codec("snappy").compress(v.astype("<u4").tobytes(), asbytes=True)
    return np.concatenate([np.array([len(data)], np.uint32), np.frombuffer(data + bytes(-len(data) % 4), "<u4")])


def _unsnappy(words: Words, n: int) -> tuple[np.ndarray, int]:
    size = int(words[0])
    data = pa.Codec("snappy").decompress(words[1:].tobytes()[:size], decompressed_size=4 * n, asbytes=True)
    return np.frombuffer(data, "<u4").astype(np.int64), 1 + (size + 3) // 4


_VARINT = Codec(lambda v: _varint(v, True), lambda w, n: _unvarint(w, n, True))
_VBYTE = Codec(lambda v: _varint(v, False), lambda w, n: _unvarint(w, n, False))
_QUADS = composed(Codec(_group_simple, _ungroup_simple, 4))

CODECS: dict[str, Codec] = {
    "copy": Codec(lambda v: v.astype(np.uint32), lambda w, n: (w[:n].astype(np.int64), n)),
    "varint": _VARINT,
    "vbyte": _VBYTE,
    "maskedvbyte": _VBYTE,
    "streamvbyte": Codec(lambda v: _grouped(v, True), lambda w, n: _ungrouped(w, n, True)),
    "varintgb": Codec(lambda v: _grouped(v, False), lambda w, n: _ungrouped(w, n, False)),
    "varintg8iu": Codec(_g8iu, _ung8iu),
    **{f"fastbinarypacking{m}": composed(_binary(m, 4)) for m in (8, 16, 32)},
    "BP32": composed(_binary(32, 4)),
    "simdbinarypacking": composed(_binary(128, 1)),
    **{f"{p}fastpfor{n}": composed(_patching(n, "bits", lambda v, s=not p: fastpfor_width(v, s))) for p in ("", "simd") for n in (128, 256)},
    **{f"{p}simplepfor": composed(_patching(128, "simple8b", lambda v: fastpfor_width(v, False, 0))) for p in ("", "simd")},
    "pfor": composed(_linked(False)),
    "simdpfor": composed(_linked(False)),
    "pfor2008": composed(_linked(True)),
    **{f"{p}newpfor": composed(_patching(128, "simple16", newpfor_width)) for p in ("", "simd")},
    **{f"{p}optpfor": composed(_patching(128, "simple16", optpfor_width)) for p in ("", "simd")},
    **WORD_CODERS,
    "simdgroupsimple": _QUADS,
    "simdgroupsimple_ringbuf": composed(Codec(lambda v: _group_simple(v, True), lambda w, n: _ungroup_simple(w, n, True), 4)),
    "vsencoding": Codec(_vs, _unvs),
    "snappy": Codec(_snappy, _unsnappy),
}


def codec(name: str) -> Codec:
    if name not in CODECS:
        raise ValueError(f"no codec {name!r}; there are {', '.join(CODECS)}")
    return CODECS[name]


def round_trip(pieces: DataFrame, names: list[str] | None = None, delta: bool = False) -> DataFrame:
    """(codec, array_id, piece, n, words, mismatches) of each codec on each of pieces(array_id, piece, a): values that decoding changes.

    delta: the differences of neighbours are coded and summed up again. A piece that is not sorted is refused then: its words
    and mismatches are null. Codecs are registered by name, so a plan holds names only; an unknown name fails before anything runs.
    """
    names = list(CODECS) if names is None else names
    for name in names:
        codec(name)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                v = np.array(r.a, np.int64)
                if delta and (np.diff(v) < 0).any():
                    out.append((r.codec, r.array_id, r.piece, len(v), None, None))
                    continue
                words = codec(r.codec).encode(np.diff(v, prepend=0) if delta else v)
                back, _ = codec(r.codec).decode(words, len(v))
                back = np.cumsum(back) if delta else back
                wrong = len(v) if len(back) != len(v) else int((back != v).sum())
                out.append((r.codec, r.array_id, r.piece, len(v), len(words), wrong))
            yield pd.DataFrame(out, columns=["codec", "array_id", "piece", "n", "words", "mismatches"]).astype({"words": "Int64", "mismatches": "Int64"})

    each = pieces.select("array_id", "piece", "a", F.explode(F.array(*[F.lit(n) for n in names])).alias("codec"))
    return each.mapInPandas(rows, "codec string, array_id long, piece long, n long, words long, mismatches long")


def summary(trips: DataFrame) -> DataFrame:
    """(codec, arrays, n, words, mismatches, bits_per_int) over all arrays."""
    sums = trips.groupBy("codec").agg(F.count_distinct("array_id").alias("arrays"), *[F.sum(c).alias(c) for c in ("n", "words", "mismatches")])
    return sums.withColumn("bits_per_int", F.round(F.col("words").cast("double") * 32 / F.col("n"), 6))
