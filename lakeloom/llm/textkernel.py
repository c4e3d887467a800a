"""Word and shingle hashes of whole texts, computed on the bytes of Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. A word's hash is a polynomial of its bytes
modulo 2^64, passed through a finalizer; a shingle's hash is a polynomial of its words' hashes, finalized again.
Texts are taken in slices of about SLICE bytes, each text whole, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_M = np.uint64(0xD1342543DE82EF95)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of letters only: every ASCII byte that is no letter separates.
LETTERS_ONLY = np.ones(256, dtype=bool)
LETTERS_ONLY[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Words of letters and digits.
ALNUM_ONLY = LETTERS_ONLY.copy()
ALNUM_ONLY[48:58] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * SLICE)
        for key, base in (("up", _P), ("down", _P_INV)):
            table = np.ones(size, dtype=np.uint64)
            table[1:] = base
            np.multiply.accumulate(table, out=table)
            _powers[key] = table
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows with about SLICE bytes. Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word (a run of bytes of which space is False), the text's number for every word, and the words' first and past-the-last bytes."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_of = offsets[1:] - 1
    after[ends_of[ends_of >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(len(data))
    values = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * inside
    values *= up[: len(data)]
    hashes = mixed(np.add.reduceat(values, starts) * down[starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_beginnings(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each word: its hash and those of its first bytes, as many as each of sizes says; and the text's number of each
    word. Where a word is no longer than that, its own hash stands again."""
    words, of, starts, ends = word_hashes(data, offsets, space)
    out = np.repeat(words[:, None], 1 + len(sizes), axis=1)
    if not len(words):
        return out, of
    up, down = _power_tables(len(data))
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=upto[1:])
    for i, size in enumerate(sizes):
        longer = np.flatnonzero(ends - starts > size)
        at = starts[longer]
        out[longer, i + 1] = mixed((upto[at + size] - upto[at]) * down[at] + np.uint64(size))
    return out, of


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _M
    for j in range(1, k):
        out = (out + words[j : j + n]) * _M
    return mixed(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For every text in order its sorted distinct k-word shingles; with fewer words the whole sequence as one; without words none."""
    for _, data, offsets in text_slices(column):
        words, texts, _, _ = word_hashes(data, offsets)
        bounds = np.searchsorted(texts, np.arange(len(offsets)))
        shingles = shingle_hashes(words, k)
        for i in range(len(offsets) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= k:
                yield np.unique(shingles[a : b - k + 1])
            elif b > a:
                yield mixed(shingle_hashes(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield words[:0]


class Lookup:
    """Places of hashes in a sorted table; a bitmap of their low bits settles most misses."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = max(16, min(26, int(len(self.keys) * 16).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self.keys & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of hashes are keys, their places in keys)."""
        if not len(self.keys):
            none = np.zeros(0, np.int64)
            return none, none
        maybe = np.flatnonzero(self.seen[hashes & self.mask])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[maybe]
        return maybe[hit], at[hit]
