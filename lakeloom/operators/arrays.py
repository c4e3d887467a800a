"""Integer arrays given as rows (array_id, pos, v), pos from 0 without gaps: deltas and back, pieces, selection.

Work goes by runs of BLOCK positions, so an array of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions that one task takes together.
BLOCK = 65_536


def _block(pos: Column) -> Column:
    return F.floor(pos / BLOCK).cast("long")


def _dealt(a: DataFrame, more: int) -> DataFrame:
    """a with _b, a row's block; the last `more` rows of each block come a second time, under the next one."""
    blocks = F.array_distinct(F.array(_block(F.col("pos")), _block(F.col("pos") + more)))
    return a.select("array_id", "pos", "v", F.explode(blocks).alias("_b"))


def _own(dealt: DataFrame) -> DataFrame:
    return dealt.where(_block(F.col("pos")) == F.col("_b"))


def _by_pos() -> Window:
    return Window.partitionBy("array_id", "_b").orderBy("pos")


def previous(a: DataFrame) -> DataFrame:
    """a with prev, the value before; null for an array's first."""
    return _own(_dealt(a, 1).withColumn("prev", F.lag("v").over(_by_pos()))).drop("_b")


def delta(a: DataFrame) -> DataFrame:
    """v less the value before it; the first stays."""
    return previous(a).select("array_id", "pos", (F.col("v") - F.coalesce("prev", F.lit(0))).alias("v"))


def _is_short(stride: int) -> Column:
    """Whether an array has `stride` values at most; such a one lies in its first block."""
    return (F.col("_b") == 0) & (F.count("*").over(Window.partitionBy("array_id", "_b")) <= stride)


def delta_stride(a: DataFrame, stride: int = 4) -> DataFrame:
    """v less the value `stride` places before it; the first ones stay. Arrays of `stride` values or fewer get plain deltas."""
    lags = [F.lag("v", k).over(_by_pos()) for k in (1, stride)]
    dealt = _dealt(a, stride).withColumn("prev", F.when(_is_short(stride), lags[0]).otherwise(lags[1]))
    return _own(dealt).select("array_id", "pos", (F.col("v") - F.coalesce("prev", F.lit(0))).alias("v"))


def _summed(d: DataFrame) -> DataFrame:
    """Running sums of d(array_id, _b, _lane, pos, v) in each lane: those of the blocks before, then those inside."""
    keys = ["array_id", "_lane", "_b"]
    earlier = Window.partitionBy("array_id", "_lane").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*keys).agg(F.sum("v").alias("_s")).select(*keys, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    inside = F.sum("v").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return d.join(before, keys).select("array_id", "pos", (F.col("_s") + inside).alias("v"))


def undo_delta(d: DataFrame) -> DataFrame:
    return _summed(d.select("array_id", "pos", "v", _block(F.col("pos")).alias("_b"), F.lit(0).alias("_lane")))


def undo_delta_stride(d: DataFrame, stride: int = 4) -> DataFrame:
    placed = d.select("array_id", "pos", "v", _block(F.col("pos")).alias("_b"))
    return _summed(placed.withColumn("_lane", F.when(_is_short(stride), 0).otherwise(F.col("pos") % stride)))


def gaps(a: DataFrame, distinct: bool = True) -> DataFrame:
    """Differences of neighbours (n - 1 of them), less one more for sets of distinct values."""
    g = F.col("v") - F.col("prev")
    return previous(a).where("prev IS NOT NULL").select("array_id", "pos", (g - 1 if distinct else g).alias("v"))


def unsorted_arrays(a: DataFrame) -> DataFrame:
    """The arrays that are not sorted, which delta coding refuses."""
    return previous(a).where("v < prev").select("array_id").distinct()


def lengths(a: DataFrame) -> DataFrame:
    return a.groupBy("array_id").agg(F.count("*").alias("n"))


def selected(a: DataFrame, least: int = 1, most: int | None = None, count: int | None = None) -> DataFrame:
    """Those arrays of a that have `least` to `most` values, the `count` first of these by array_id."""
    kept = lengths(a).where(F.col("n").between(least, (1 << 62) if most is None else most))
    kept = kept if count is None else kept.orderBy("array_id").limit(count)
    return a.join(kept.select("array_id"), "array_id", "left_semi")


def as_pieces(a: DataFrame, size: int = BLOCK) -> DataFrame:
    """(array_id, piece, a): each array as lists of at most `size` values."""
    piece = F.floor(F.col("pos") / size).cast("long").alias("piece")
    return a.groupBy("array_id", piece).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x.v).alias("a"))


def as_arrays(a: DataFrame) -> DataFrame:
    """(array_id, a): each array as one list, for arrays that are known to be short; as_pieces takes any."""
    return as_pieces(a, 1 << 31).select("array_id", "a")
