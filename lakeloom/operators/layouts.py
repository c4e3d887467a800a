"""The index layouts by name: how keys and postings are stored, and the bytes that takes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import batches
from ..ranges import running
from ..sources.lake import Wide
from .codec_sizes import posting_bytes


@dataclass(frozen=True)
class Layout:
    """keys: plain, short, front or incr; once: each key is stored once; postings: plain, gve, gve_split, vbyte, pfor or pfor_split;
    block: keys coded together; arena: payloads lie in buffers."""

    keys: str
    once: bool
    postings: str
    block: int = 0
    arena: bool = False


LAYOUTS: dict[str, Layout] = {
    "baseline": Layout("plain", False, "plain"),
    "baselinex": Layout("plain", False, "plain"),
    "dedup_hash": Layout("plain", True, "plain"),
    "dedup_btree": Layout("plain", True, "plain"),
    "ns+dedup": Layout("plain", True, "gve"),
    "ns": Layout("plain", False, "gve"),
    "ns_arena": Layout("plain", False, "gve", arena=True),
    "smaz": Layout("short", False, "plain"),
    "smaz+dedup": Layout("short", True, "plain"),
    "smaz+ns+dedup": Layout("short", True, "gve"),
    "smaz+pfor+dedup": Layout("short", True, "pfor"),
    "frontcoding": Layout("front", False, "plain", 8),
    "frontcoding+dedup": Layout("front", True, "plain", 8),
    "incr": Layout("incr", False, "plain", 8),
    "incr+dedup": Layout("incr", True, "plain", 16),
    "incr+dedup+ns": Layout("incr", True, "gve", 16),
    "incr_adv+dedup+ns": Layout("incr", True, "gve", 16),
    "incr_adv+dedup+ns_adv": Layout("incr", True, "gve_split", 16),
    "vbyte+ns+dedup": Layout("plain", True, "vbyte"),
    "pfor+dedup": Layout("plain", True, "pfor", arena=True),
    "pfor_split+dedup": Layout("plain", True, "pfor_split", arena=True),
    "vbyte+arena+ns+dedup": Layout("plain", True, "vbyte", arena=True),
    "vbyte+ns+incr+dedup": Layout("incr", True, "vbyte", 16),
}


def layout(name: str) -> Layout:
    if name not in LAYOUTS:
        raise ValueError(f"no layout {name!r}; there are {', '.join(LAYOUTS)}")
    return LAYOUTS[name]


def arena_offsets(cells: DataFrame) -> DataFrame:
    """(tokenized, start, length): each text's slice of one buffer of group-varint postings in the order of texts."""
    sized = posting_bytes(cells).select("tokenized", F.col("gve").alias("length"))
    return running(sized, "tokenized", "length").select("tokenized", "start", "length")


#: The layouts whose sizes a model gives; short keys depend on a learned book, pfor on the values of each block.
MODELLED = [n for n, x in LAYOUTS.items() if x.keys != "short" and not x.postings.startswith("pfor")]


def _widths(x: np.ndarray) -> np.ndarray:
    return 1 + (x >= 1 << 8).astype(np.int64) + (x >= 1 << 16) + (x >= 1 << 24)


def _grouped_bytes(n: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of n group varints whose byte widths sum up to `widths`: a word that counts them, widths, values, whole words."""
    return -(-(4 + -(-n // 4) + widths) // 4) * 4


def _framed_bytes(size: np.ndarray) -> np.ndarray:
    return batches.varint_sizes(size) + size


def model_list_bytes(how: str, ints: np.ndarray, sizes: np.ndarray) -> int:
    """Bytes of the payloads of lists of sizes[i] integers (tableid, colid, rowid, ...) by formula; a list has one tableid."""
    n, ids = sizes // 3, ints.reshape(-1, 3)
    summed = lambda x: np.diff(batches.offsets_of(x)[np.append(0, np.cumsum(n))])
    t, (c, r) = _widths(ids[np.cumsum(n) - n, 0]) if len(ids) else n, (summed(_widths(ids[:, i])) for i in (1, 2))
    if how == "plain":
        body = 12 * n
    elif how == "gve":
        body = _grouped_bytes(3 * n, n * t + c + r)
    elif how == "gve_split":
        body = _framed_bytes(_grouped_bytes(n, t + n - 1)) + _framed_bytes(_grouped_bytes(2 * n, c + r))
    elif how == "vbyte":
        body = _framed_bytes(summed(batches.varint_sizes(ids[:, 1]) + batches.varint_sizes(ids[:, 2]))) + _framed_bytes(_grouped_bytes(n, n * t))
    else:
        raise ValueError(f"no model of {how!r}")
    return int((batches.varint_sizes(sizes) + body).sum())


def _shared(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes in common of the keys at places a and b; keys that lie in one place are not compared."""
    p = size[a].copy()
    on = np.flatnonzero((start[a] != start[b]) | (p != size[b]))
    a, b = a[on], b[on]
    p[on] = batches.shared(data, start[a], size[a], start[b], size[b])
    return p


def model_key_bytes(how: str, keys: tuple[np.ndarray, np.ndarray, np.ndarray], firsts: np.ndarray, book: object = None) -> int:
    """Bytes of sorted keys (data, starts, sizes) in blocks that begin at `firsts`, by formula. A block's common prefix is that of its first and last key."""
    data, start, size = keys
    if how == "plain":
        return int(size.sum())
    ends = np.append(firsts[1:], len(size))
    if how == "front":
        p = _shared(data, start, size, firsts, ends - 1)
        return int(_framed_bytes(p).sum() + _framed_bytes(size - np.repeat(p, ends - firsts)).sum())
    if how != "incr":
        raise ValueError(f"no model of {how!r}")
    more = np.setdiff1d(np.arange(len(size)), firsts, assume_unique=True)
    p = _shared(data, start, size, more - 1, more)
    return int(_framed_bytes(size[firsts]).sum() + batches.varint_sizes(p).sum() + _framed_bytes(size[more] - p).sum())


def modelled_sizes(cells: DataFrame | list[Wide]) -> DataFrame:
    """(layout, cells, keys, blocks, payloads, key_bytes, posting_bytes) of the MODELLED layouts, without coding anything."""
    from .tally import sizes

    return sizes(cells, MODELLED, keys_by=model_key_bytes, lists_by=model_list_bytes)
