"""Column functions on bit and byte widths, sizes and shared prefixes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def width(v: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v))).cast("long")


def width_least_one(v: Column) -> Column:
    """Bits of a non-negative integer; 1 for 0."""
    return F.when(v <= 1, 1).otherwise(F.length(F.bin(v))).cast("long")


def varint_bytes(v: Column) -> Column:
    """Bytes of a value below 2^35 in groups of 7 bits."""
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5).cast("long")


def byte_width(v: Column) -> Column:
    """1 to 4: the bytes of a value below 2^32."""
    return F.when(v < 1 << 8, 1).when(v < 1 << 16, 2).when(v < 1 << 24, 3).otherwise(4).cast("long")


def ceil_div(a: Column, d: int | Column) -> Column:
    """a / d rounded up, for integers."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.floor((a + d - 1) / d).cast("long")


def padded(n: Column, to: int) -> Column:
    """n rounded up to a multiple of `to`."""
    return ceil_div(n, to) * to


def exceeds(v: Column, b: int) -> Column:
    """v needs more than b bits."""
    return v >= F.lit(1 << b)


def low_high(v: Column, b: int) -> tuple[Column, Column]:
    """The low b bits of an exception and the rest."""
    return v.bitwiseAND(F.lit((1 << b) - 1)), F.shiftrightunsigned(v, b)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes that the UTF-8 forms of two strings share.

    The hexadecimal forms are compared digit by digit up to the first difference.
    """
    x, y = F.hex(a), F.hex(b)
    digits = F.least(F.length(x), F.length(y))
    same = F.aggregate(
        F.sequence(F.lit(0), digits),
        F.lit(0),
        lambda n, i: F.when((i > 0) & (n == i - 1) & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))), i).otherwise(n),
    )
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.floor(same / 2)).cast("long")


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def divisible(n: Column, k: int) -> Column:
    return n % k == 0


def split_any(s: Column, delimiters: str) -> Column:
    """The parts of a string between any of several delimiter characters; empty parts are dropped."""
    return F.filter(F.split(s, "[" + "".join("\\" + c for c in delimiters) + "]"), lambda x: x != "")


def lookahead_width(a: Column, budget: int = 32) -> Column:
    """The least width w of 1 to 30 bits for which the first budget div w values (all of a shorter array, one at least) fit into w bits each, so that
    the most of them share a word of `budget` bits; null for an empty array or where none fits."""
    fits = lambda w: F.aggregate(F.slice(a, 1, max(1, budget // w)), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)) < (1 << w)
    found = F.when(F.size(a) == 0, None)
    for w in range(1, 31):
        found = found.when(fits(w), w)
    return found.cast("long")
