"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group and stay together. Groups, the largest first, go to the least-loaded shard (ties: the lower
shard number) through a heap. The law kept is `bytes`: the shards' sizes are near equal, as far as whole groups allow.

The schedule needs only how many groups there are of each size, so the driver holds one entry per distinct group size, never a
group. Sizes above 2^20 are rounded up to 20 significant bits for scheduling, so the table has at most 2^20 entries plus 2^19
for each doubling above; which group of a size goes to which shard is settled by its hash, in the cluster.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ranks import with_slots
from .store import written

EXACT_BITS = 20


def lpt(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, number of its groups that go to each shard), the largest size first. classes: (size, number of groups).

    The heap takes one group at a time; of a size with very many groups, all but the last `8 * shards` are dealt by levelling:
    every shard gets as many as bring it up to the same load, which is what the heap would have done.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sorted(classes, reverse=True):
        got = [0] * shards
        left = count
        if count > 64 * shards and size > 0:
            loads = sorted(heap, key=lambda x: x[1])
            bulk = count - 8 * shards
            low, high = min(load for load, _ in loads), max(load for load, _ in loads) + size * (bulk // shards + 1)
            while low < high:
                mid = (low + high + 1) // 2
                if sum(max(0, (mid - load) // size) for load, _ in loads) <= bulk:
                    low = mid
                else:
                    high = mid - 1
            heap = []
            for load, s in loads:
                got[s] = max(0, (low - load) // size)
                heap.append((load + got[s] * size, s))
            heapq.heapify(heap)
            left -= sum(got)
        for _ in range(left):
            load, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        yield size, got


def plan_table(classes: Iterable[tuple[int, int]], shards: int) -> pa.Table:
    """(class, upto): one row for each size; shard s takes the groups of ranks from upto[s - 1] to below upto[s]."""
    sizes, upto = array("q"), array("q")
    for size, got in lpt(classes, shards):
        sizes.append(size)
        upto.extend(accumulate(got))
    flat = pa.array(np.frombuffer(upto, np.int64) if upto else [], pa.int64())
    cuts = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * shards)
    return pa.table({"class": pa.array(np.frombuffer(sizes, np.int64) if sizes else [], pa.int64()), "upto": pa.ListArray.from_arrays(cuts, flat)})


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs(doc_id, text).

    size: UTF-8 bytes of the text plus 1; text_crc32: unsigned, of the UTF-8 bytes. Null text counts as empty and is grouped with
    it. slot: 0, 1, 2, ... in each shard. grown_shard is null (it belongs to another law). Repeated rows and null ids are each
    placed, equal rows in any order of slots; of groups of one size the order of their hashes decides; texts of any length count
    whole; an empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = written(rows)
    own = ["key", "text_crc32", "size"]
    groups = rows.groupBy(*own).agg(F.sum("size").alias("total"))
    unit = f"shiftleft(1L, greatest(length(bin(total)) - {EXACT_BITS}, 0))"
    groups = written(groups.withColumn("class", F.expr(f"total + pmod(-total, {unit})")))
    counts = groups.groupBy("class").count().toArrow()
    classes = zip(counts.column(0).to_numpy().tolist(), counts.column(1).to_numpy().tolist(), strict=True)
    plan = docs.sparkSession.createDataFrame(plan_table(classes, shards))
    ranked = with_slots(groups, "class", own, "rank")
    placed = ranked.join(plan, "class").select(*own, F.expr("cast(size(filter(upto, x -> x <= rank)) as int)").alias("shard"))
    out = with_slots(rows.join(placed, own), "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
