"""Bytes of key blocks, short strings and posting lists, and back."""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np

from .codecs import codec


def varint(x: int) -> bytes:
    """7 bits a byte, the low ones first; the high bit marks that more follow."""
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        byte = data[at]
        at += 1
        x |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return x, at


def shared(a: bytes, b: bytes) -> int:
    """Leading bytes in common."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def front(keys: list[str]) -> bytes:
    """The prefix of all keys once, then the rest of each; every part with its length before it."""
    raw = [k.encode() for k in keys]
    p = min((shared(raw[0], k) for k in raw), default=0)
    return varint(p) + (raw[0][:p] if raw else b"") + b"".join(varint(len(k) - p) + k[p:] for k in raw)


def unfront(data: bytes) -> list[str]:
    p, at = read_varint(data, 0)
    prefix, at, out = data[at : at + p], at + p, []
    while at < len(data):
        n, at = read_varint(data, at)
        out.append((prefix + data[at : at + n]).decode())
        at += n
    return out


def incremental(keys: list[str]) -> bytes:
    """The first key whole; of each other one the length shared with the key before, the rest's length and the rest."""
    out, last = bytearray(), b""
    for i, key in enumerate(keys):
        raw = key.encode()
        p = shared(last, raw) if i else 0
        out += (varint(p) if i else b"") + varint(len(raw) - p) + raw[p:]
        last = raw
    return bytes(out)


def unincremental(data: bytes) -> list[str]:
    out, at, last = [], 0, b""
    while at < len(data):
        p, at = read_varint(data, at) if out else (0, at)
        n, at = read_varint(data, at)
        last = last[:p] + data[at : at + n]
        at += n
        out.append(last.decode())
    return out


class ShortStrings:
    """Short strings by a book of at most 253 fragments: a byte below 254 is a fragment, 254 a single byte, 255 a counted run."""

    def __init__(self, book: list[bytes]):
        if len(book) > 253 or len(set(book)) < len(book) or b"" in book:
            raise ValueError("not a book of fragments")
        self.book = book
        self.code = {f: i for i, f in enumerate(book)}
        self.longest = max(map(len, book), default=1)

    @classmethod
    def learned(cls, keys: list[str], longest: int = 6) -> ShortStrings:
        """The fragments that save most over some keys, ties in byte order."""
        saved: Counter[bytes] = Counter()
        for key in keys:
            raw = key.encode()
            for n in range(1, longest + 1):
                for i in range(len(raw) - n + 1):
                    saved[raw[i : i + n]] += 2 * n - 1
        return cls([f for f, _ in sorted(saved.items(), key=lambda x: (-x[1], x[0]))[:253]])

    @cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """The fragments as a tree: the node that each byte leads to (1 is the root, 0 no node), and each node's code (-1: none ends there)."""
        steps, codes = [np.zeros(256, np.int32), np.zeros(256, np.int32)], [-1, -1]
        for fragment, c in self.code.items():
            node = 1
            for byte in fragment:
                if not steps[node][byte]:
                    steps[node][byte] = len(steps)
                    steps.append(np.zeros(256, np.int32))
                    codes.append(-1)
                node = int(steps[node][byte])
            codes[node] = c
        return np.stack(steps), np.array(codes)

    def encode(self, key: str) -> bytes:
        raw, out, lost, at = key.encode(), bytearray(), bytearray(), 0

        def flush() -> None:
            while lost:
                part = bytes(lost[:256])
                out.extend(bytes([254]) + part if len(part) == 1 else bytes([255, len(part) - 1]) + part)
                del lost[:256]

        while at < len(raw):
            for n in range(min(self.longest, len(raw) - at), 0, -1):
                if (c := self.code.get(raw[at : at + n])) is not None:
                    flush()
                    out.append(c)
                    at += n
                    break
            else:
                lost.append(raw[at])
                at += 1
        flush()
        return bytes(out)

    def decode(self, data: bytes) -> str:
        out, at = bytearray(), 0
        while at < len(data):
            c, at = data[at], at + 1
            if c == 254:
                out.append(data[at])
                at += 1
            elif c == 255:
                n = data[at] + 1
                out += data[at + 1 : at + 1 + n]
                at += 1 + n
            else:
                out += self.book[c]
        return out.decode()


# posting lists: integers (tableid, colid, rowid, tableid, ...) to bytes; the number of integers is stored, so nothing is padded


def _words(name: str, ints: list[int]) -> bytes:
    return codec(name).encode(np.array(ints, np.int64)).tobytes()


def _unwords(name: str, data: bytes, n: int) -> list[int]:
    return codec(name).decode(np.frombuffer(data, np.uint32), n)[0].tolist()


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(varint(len(p)) + p for p in parts)


def _unframed(data: bytes, at: int) -> list[bytes]:
    out = []
    while at < len(data):
        n, at = read_varint(data, at)
        out.append(data[at : at + n])
        at += n
    return out


def encode_postings(ints: list[int], how: str) -> bytes:
    """plain, gve (group varint), gve_split (tableids as differences apart), vbyte (colid and rowid; tableids by group varint),
    pfor, or pfor_split (three runs)."""
    n, t, rest = len(ints), ints[0::3], [x for i, x in enumerate(ints) if i % 3]
    head = varint(n)
    if how == "plain":
        return head + np.array(ints, np.uint32).tobytes()
    if how == "gve":
        return head + _words("varintgb", ints)
    if how == "gve_split":
        return head + _framed([_words("varintgb", np.diff(t, prepend=0).tolist()), _words("varintgb", rest)])
    if how == "vbyte":
        return head + _framed([b"".join(map(varint, rest)), _words("varintgb", t)])
    if how == "pfor":
        return head + _words("simdfastpfor128", ints)
    if how == "pfor_split":
        return head + _framed([_words("simdfastpfor128", ints[i::3]) for i in range(3)])
    raise ValueError(f"no posting code {how!r}")


def decode_postings(data: bytes, how: str) -> list[int]:
    n, at = read_varint(data, 0)
    if how == "plain":
        return np.frombuffer(data[at:], np.uint32).astype(np.int64).tolist()
    if how in ("gve", "pfor"):
        return _unwords({"gve": "varintgb", "pfor": "simdfastpfor128"}[how], data[at:], n)
    parts = _unframed(data, at)
    if how == "pfor_split":
        runs = [_unwords("simdfastpfor128", p, n // 3) for p in parts]
        return [x for row in zip(*runs, strict=True) for x in row]
    if how == "gve_split":
        t, rest = np.cumsum(_unwords("varintgb", parts[0], n // 3)).tolist(), _unwords("varintgb", parts[1], n // 3 * 2)
    elif how == "vbyte":
        rest, at = [], 0
        while at < len(parts[0]):
            x, at = read_varint(parts[0], at)
            rest.append(x)
        t = _unwords("varintgb", parts[1], n // 3)
    else:
        raise ValueError(f"no posting code {how!r}")
    return [x for i, a in enumerate(t) for x in (a, rest[2 * i], rest[2 * i + 1])]
