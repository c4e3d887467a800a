"""Synthetic integer arrays: uniform, clustered and Zipf, as rows (pos, v), repeatable by seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def uniform(spark: SparkSession, n: int, below: int, seed: int = 7) -> DataFrame:
    """n distinct sorted values below `below`, each set as likely as any other: those with the n smallest hashes."""
    if n > below:
        raise ValueError("there are not so many values")
    chosen = spark.range(below).select(F.col("id").alias("v"), F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "v").limit(n)
    return chosen.select((F.row_number().over(Window.orderBy("v")) - 1).cast("long").alias("pos"), "v")


def _clustered(rng: np.random.Generator, n: int, low: int, high: int) -> list[np.ndarray]:
    """n distinct sorted values of [low, high): a range is halved again and again, with the values shared out unevenly."""
    out, open_ = [], [(n, low, high)]
    while open_:
        n, low, high = open_.pop()
        if n == 0:
            continue
        if high - low == n:
            out.append(np.arange(low, high))
            continue
        if n < 10:
            out.append(_distinct(rng, n, high - low) + low)
            continue
        half = n // 2
        cut = int(rng.integers(low + half, high - (n - half) + 1))
        p = rng.random()
        left = rng.random() < 0.5
        if p <= 0.25:  # one side spread evenly
            even, rest = ((half, low, cut), (n - half, cut, high)) if left else ((n - half, cut, high), (half, low, cut))
            out.append(_distinct(rng, even[0], even[2] - even[1]) + even[1])
            open_.append(rest)
        else:
            open_ += [(half, low, cut), (n - half, cut, high)]
    return out


def clustered(spark: SparkSession, n: int, below: int, seed: int = 7, parts: int = 16) -> DataFrame:
    """n distinct sorted values below `below` in clusters; the range is cut into parts that are made apart."""
    counts = np.random.default_rng(seed).multinomial(n, np.ones(parts) / parts)
    edges = [below * i // parts for i in range(parts + 1)]
    if any(c > b - a for c, a, b in zip(counts, edges, edges[1:], strict=False)):
        raise ValueError("there are not so many values")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    plan = [(i, int(counts[i]), int(starts[i]), edges[i], edges[i + 1]) for i in range(parts)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                v = np.sort(np.concatenate([np.zeros(0, np.int64), *_clustered(np.random.default_rng([seed, r.part]), r.n, r.low, r.high)]))
                yield pd.DataFrame({"pos": np.arange(len(v)) + r.start, "v": v.astype(np.int64)})

    return spark.createDataFrame(plan, "part long, n long, start long, low long, high long").repartition(parts, "part").mapInPandas(rows, "pos long, v long")


def zipf(spark: SparkSession, n: int, exponent: float, domain: int, seed: int = 7) -> DataFrame:
    """n values below `domain` with P(v) in proportion to (v + 1) to the power -exponent, by the inverse of the distribution."""
    upto = np.cumsum(np.arange(1, domain + 1, dtype=np.float64) ** -exponent)
    upto /= upto[-1]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            u = (frame.h.to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            yield pd.DataFrame({"pos": frame.pos, "v": np.minimum(np.searchsorted(upto, u, side="right"), domain - 1)})

    return spark.range(n).select(F.col("id").alias("pos"), F.xxhash64("id", F.lit(seed)).alias("h")).mapInPandas(rows, "pos long, v long")


def masked(spark: SparkSession, n: int, bits: int, seed: int = 7) -> DataFrame:
    """n values of `bits` random bits."""
    return spark.range(n).select(F.col("id").alias("pos"), F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << bits) - 1)).alias("v"))


def _distinct(rng: np.random.Generator, n: int, below: int) -> np.ndarray:
    """n distinct sorted values below `below`, every set as likely: from repeated draws, or by what is left out where most are taken."""
    if 2 * n > below:
        kept = np.ones(below, bool)
        kept[_distinct(rng, below - n, below)] = False
        return np.flatnonzero(kept)
    held = np.zeros(0, np.int64)
    while len(held) < n:
        held = np.unique(np.concatenate([held, rng.integers(0, below, n - len(held) + 16)]))
    return np.sort(rng.permutation(held)[:n])


#: The sets of arrays of the codec benchmark, as kind, number of arrays, their length, bound of the values. `short` sets take 2^20
#: values in all for a length of 2^15 or 2^20.
MODES = {
    "uniformdenseclassic": ("uniform", 1 << 5, 1 << 18, 1 << 27),
    "uniformsparseclassic": ("uniform", 1 << 14, 1 << 9, 1 << 27),
    "clusterdenseclassic": ("clustered", 1 << 5, 1 << 18, 1 << 27),
    "clustersparseclassic": ("clustered", 1 << 14, 1 << 9, 1 << 27),
    "uniformdense": ("uniform", 1 << 3, 1 << 22, 1 << 29),
    "uniformsparse": ("uniform", 1 << 13, 1 << 12, 1 << 29),
    "clusterdense": ("clustered", 1, 1 << 23, 1 << 26),
    "clustersparse": ("clustered", 1 << 13, 1 << 12, 1 << 26),
}
for _kind in ("cluster", "uniform"):
    for _end, _all, _lengths in (("dynamic", 25, (15, 20, 25)), ("dynamicsmall", 20, (15, 20))):
        MODES |= {f"{_kind}{_end}-{k}": ("clustered" if _kind == "cluster" else "uniform", 1 << _all - k, 1 << k, 1 << 29) for k in _lengths}


def benchmark_arrays(spark: SparkSession, mode: str, seed: int = 7, count: int | None = None) -> DataFrame:
    """(array_id, a) of a mode, `count` arrays instead of its own number if given. Each array is made by one task from its own seed; an unknown
    mode is refused."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    kind, arrays, n, below = MODES[mode]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame.id.tolist():
                rng = np.random.default_rng([seed, i])
                a = _distinct(rng, n, below) if kind == "uniform" else np.sort(np.concatenate(_clustered(rng, n, 0, below)))
                yield pd.DataFrame({"array_id": [i], "a": [a.astype(np.int64)]})

    made = arrays if count is None else count
    return spark.range(0, made, 1, max(1, min(made, made * n >> 18))).mapInPandas(rows, "array_id long, a array<long>")
