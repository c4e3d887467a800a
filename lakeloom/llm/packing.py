"""Packing into length buckets whose boundaries minimise padding.

A dynamic program over the whole table's histogram of lengths chooses the boundaries: every text is padded to its bucket's
boundary, so the cost of a bucket is its number of texts times its boundary. The program is exact. Inside each bucket batches of
as many texts as fit the token budget are formed.

The histogram is the only thing that the driver holds: m distinct lengths need m * m / 2 tokens at least, so 1e13 tokens have
4.5 million distinct lengths at most.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .ranks import with_slots
from .store import written


def boundaries(histogram: Iterable[tuple[int, int]], buckets: int) -> list[int]:
    """The boundaries (the last is the greatest length) that minimise padding; as many as buckets, or one for each length.

    best[i] = min over p < i of last[p] + length[i] * (texts up to i - texts up to p) is a lower envelope of lines whose slopes
    fall and whose queries rise, so each bucket's row takes linear time. All in integers; ties take the earlier cut. Held are
    4 bytes a length and bucket for the cuts, and 7 numbers of 8 bytes a length.
    """
    lengths, upto = array("q"), array("q", [0])
    for length, count in sorted((length, count) for length, count in histogram if count):
        lengths.append(length)
        upto.append(upto[-1] + count)
    n = len(lengths)
    if not n:
        return []
    buckets = min(buckets, n)
    last = array("q", [0])
    last.extend(lengths[i - 1] * upto[i] for i in range(1, n + 1))
    cuts = [array("i", bytes(4 * (n + 1)))]
    # the envelope's lines: slopes, bases and the cuts they stand for; those from head on are in use
    slopes, bases, places = (array("q", bytes(8 * (n + 1))) for _ in range(3))
    for j in range(2, buckets + 1):
        now, cut = array("q", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1)))
        head = end = 0
        for i in range(1, n + 1):
            p = i - 1
            if p >= j - 1:
                slope, base = -upto[p], last[p]
                while end - head >= 2 and (base - bases[end - 2]) * (slopes[end - 2] - slopes[end - 1]) < (bases[end - 1] - bases[end - 2]) * (slopes[end - 2] - slope):
                    end -= 1
                slopes[end], bases[end], places[end] = slope, base, p
                end += 1
            if i < j:
                continue
            x = lengths[i - 1]
            while end - head >= 2 and slopes[head + 1] * x + bases[head + 1] < slopes[head] * x + bases[head]:
                head += 1
            now[i], cut[i] = slopes[head] * x + bases[head] + x * upto[i], places[head]
        last = now
        cuts.append(cut)
    out, i = [], n
    for j in range(buckets - 1, -1, -1):
        out.append(lengths[i - 1])
        i = cuts[j][i]
    return out[::-1]


def word_count(column: str = "text") -> F.Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(r"[^\s]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, length: F.Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch_id, position) of every row of docs.

    length: the number of tokens, words of the text if not given (null: 0). A batch holds max(1, budget div bucket_length) texts
    of one bucket; so batch rows times bucket_length is within the budget, but for a text that exceeds it alone. Batches are
    numbered from 0 through all buckets; only a bucket's last one may be short. Repeated rows, null ids and empty texts are each
    packed, equal rows in any order; texts of any length count whole; an empty table gives an empty table; other columns are ignored.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count() if length is None else length.cast("long")).alias("n_tokens")))
    histogram = rows.groupBy("n_tokens").count().toArrow()
    lengths, counts = (histogram.column(i).to_numpy() for i in range(2))
    bounds = boundaries(zip(lengths.tolist(), counts.tolist(), strict=True), buckets)
    held = np.bincount(np.searchsorted(np.array(bounds, np.int64), lengths), counts, minlength=len(bounds)) if bounds else []
    table, first = [], 0
    for b, bound in enumerate(bounds):
        fit = max(1, budget // max(1, bound))
        count = int(held[b])
        table.append((b, bound, fit, first))
        first += -(-count // fit)
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(table, "bucket int, bucket_length long, fit long, first_batch long"))
    bucket = sum((F.when(F.col("n_tokens") > bound, 1).otherwise(0) for bound in bounds[:-1]), F.lit(0)).cast("int")
    placed = with_slots(rows.withColumn("bucket", bucket), "bucket", ["doc_id", "n_tokens"])
    out = placed.join(known, "bucket")
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", (F.col("first_batch") + F.floor(F.col("slot") / F.col("fit"))).cast("long").alias("batch_id"), (F.col("slot") % F.col("fit")).cast("long").alias("position"))
