"""Exact sizes of integer codecs and posting layouts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bits import byte_width, ceil_div, varint_bytes, width
from .arrays import BLOCK

NEW_WIDTHS = [*range(14), 16, 20]


def width_table(values: DataFrame, block: int = 128) -> DataFrame:
    """(array_id, blk, b, e, maxb, size): for each whole block and each width b of 0 to 32 the number of values wider than b.

    Built from at most 33 counts a block, not from values times widths.
    """
    w = values.select("array_id", F.floor(F.col("pos") / block).cast("long").alias("blk"), width(F.col("v")).alias("w"))
    counts = w.groupBy("array_id", "blk").agg(*[F.count_if(F.col("w") == b).alias(f"c{b}") for b in range(33)], F.max("w").alias("maxb"), F.count("*").alias("size"))
    above: list[Column] = []
    for b in range(33):
        more = [F.col(f"c{x}") for x in range(b + 1, 33)]
        above.append(sum(more[1:], more[0]) if more else F.lit(0).cast("long"))
    rows = counts.where(F.col("size") == block).select("array_id", "blk", "maxb", "size", F.posexplode(F.array(*above)).alias("b", "e"))
    return rows.select("array_id", "blk", F.col("b").cast("long").alias("b"), "e", "maxb", "size")


def _cheapest(table: DataFrame, cost: Column, block: int) -> DataFrame:
    best = F.min(F.struct("cost", (-F.col("b")).alias("nb"), "e"))
    held = table.where("b <= maxb").withColumn("cost", cost).groupBy("array_id", "blk", "maxb").agg(best.alias("x"))
    return held.select("array_id", "blk", (-F.col("x.nb")).alias("b"), F.col("x.e").alias("e"), "maxb", F.col("x.cost").alias("cost"))


def fastpfor_choice(table: DataFrame, block: int = 128, scalar: bool = True) -> DataFrame:
    """(array_id, blk, b, e, maxb, cost): width of least cost; of equal ones the greatest."""
    e, gap = F.col("e"), F.col("maxb") - F.col("b")
    cost = 8 * e + e * gap + F.col("b") * block + 8
    if scalar:
        cost = cost - F.when(gap == 1, e).otherwise(0)
    return _cheapest(table, F.when(gap == 0, F.col("b") * block).otherwise(cost), block)


def simplepfor_choice(table: DataFrame, block: int = 128) -> DataFrame:
    e, gap = F.col("e"), F.col("maxb") - F.col("b")
    return _cheapest(table, F.when(gap == 0, F.col("b") * block).otherwise(8 * e + e * gap + F.col("b") * block), block)


def newpfor_choice(table: DataFrame) -> DataFrame:
    """(array_id, blk, b, e, maxb): the least listed width with a tenth of exceptions at most, else 32."""
    fits = F.col("b").isin(NEW_WIDTHS) & (10 * F.col("e") <= F.col("size")) & (F.col("maxb") <= 28 + F.col("b"))
    chosen = table.groupBy("array_id", "blk", "maxb").agg(F.min(F.when(fits, F.struct("b", "e"))).alias("x"))
    return chosen.select("array_id", "blk", F.coalesce("x.b", F.lit(32).cast("long")).alias("b"), F.coalesce("x.e", F.lit(0).cast("long")).alias("e"), "maxb")


def pfor_cost(table: DataFrame) -> DataFrame:
    """(array_id, b, cost): one width for the array's whole blocks by b + 32 * rate of exceptions; of equal costs the least b.

    Exceptions are linked, so sparse ones under a narrow b force more; with rate E the estimate is at least (128 E - 1) / (E 2^b).
    """
    by_width = table.groupBy("array_id", "b").agg(F.sum("e").alias("e"), F.sum("size").alias("n"))
    rate = F.col("e").cast("double") / F.col("n")
    forced = (rate * 128 - 1) / (rate * F.pow(F.lit(2.0), F.col("b").cast("double")))
    cost = F.round(F.col("b") + 32 * F.when(F.col("e") > 0, F.greatest(rate, forced)).otherwise(rate), 9)
    best = by_width.groupBy("array_id").agg(F.min(F.struct(cost.alias("cost"), "b")).alias("x"))
    return best.select("array_id", "x.b", "x.cost")


def binary_packing(values: DataFrame, mini: int = 32) -> DataFrame:
    """(array_id, blk, words) of blocks of four mini blocks, each with its own width: one word of widths and the packed words."""
    w = values.select("array_id", F.floor(F.col("pos") / (4 * mini)).cast("long").alias("blk"), F.floor(F.col("pos") % (4 * mini) / mini).alias("m"), width(F.col("v")).alias("w"))
    minis = w.groupBy("array_id", "blk", "m").agg(F.max("w").alias("b"), F.count("*").alias("n"))
    sized = minis.groupBy("array_id", "blk").agg(F.sum(ceil_div(F.lit(mini) * F.col("b"), 32)).alias("packed"), F.sum("n").alias("n"))
    return sized.where(F.col("n") == 4 * mini).select("array_id", "blk", (1 + F.col("packed")).alias("words"))


def simd_packing(values: DataFrame) -> DataFrame:
    """(array_id, words): a count, four words of widths for 16 blocks of 128, and four words for each bit of a block's width."""
    w = values.select("array_id", F.floor(F.col("pos") / 128).alias("blk"), width(F.col("v")).alias("w"))
    per = w.groupBy("array_id", "blk").agg(F.max("w").alias("b"), F.count("*").alias("n")).where("n = 128")
    return per.groupBy("array_id").agg((1 + 4 * ceil_div(F.count("*"), 16) + F.sum(4 * F.col("b"))).cast("long").alias("words"))


def array_words(values: DataFrame) -> DataFrame:
    """(codec, arrays, n, words, bits_per_int) of the codecs whose size is a sum over values; arrays are coded in pieces of BLOCK values."""
    v = F.col("v")
    per = values.groupBy("array_id", F.floor(F.col("pos") / BLOCK)).agg(F.count("*").alias("n"), F.sum(varint_bytes(v)).alias("vb"), F.sum(byte_width(v)).alias("bw"))
    control = ceil_div(F.col("n"), 4)
    sizes = F.array(
        F.struct(F.lit("copy").alias("codec"), F.col("n").alias("words")),
        *[F.struct(F.lit(name).alias("codec"), ceil_div(F.col("vb"), 4).alias("words")) for name in ("varint", "vbyte", "maskedvbyte")],
        *[F.struct(F.lit(name).alias("codec"), ceil_div(4 + control + F.col("bw"), 4).alias("words")) for name in ("streamvbyte", "varintgb")],
    )
    rows = per.select("array_id", "n", F.explode(sizes).alias("x")).select("array_id", "n", "x.codec", "x.words")
    sums = rows.groupBy("codec").agg(F.count_distinct("array_id").alias("arrays"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    return sums.withColumn("bits_per_int", F.round(F.col("words").cast("double") * 32 / F.col("n"), 6))


# posting layouts


def posting_bytes(cells: DataFrame) -> DataFrame:
    """(tokenized, n, vbyte, gve, stream): bytes of each text's locations under three codes."""
    ids = [F.col(c) for c in ("tableid", "colid", "rowid")]
    vb = sum((varint_bytes(c) for c in ids[1:]), varint_bytes(ids[0]))
    bw = sum((byte_width(c) for c in ids[1:]), byte_width(ids[0]))
    per = cells.groupBy("tokenized").agg(F.count("*").alias("n"), F.sum(vb).alias("vbyte"), F.sum(bw).alias("bw"))
    control = ceil_div(3 * F.col("n"), 4)
    return per.select("tokenized", "n", "vbyte", (F.col("bw") + control).alias("gve"), (4 * ceil_div(4 + F.col("bw") + control, 4)).alias("stream"))


def split_bytes(cells: DataFrame) -> DataFrame:
    """(run, n, bytes): the three id columns of all posting lists coded apart by group varint; tableids as differences."""
    order = Window.partitionBy("tokenized").orderBy("tableid", "colid", "rowid")
    d = cells.select("tokenized", "colid", "rowid", (F.col("tableid") - F.coalesce(F.lag("tableid").over(order), F.lit(0))).alias("tableid"))
    per = d.groupBy("tokenized").agg(F.count("*").alias("n"), *[F.sum(byte_width(F.col(c))).alias(c) for c in ("tableid", "colid", "rowid")])
    runs = F.array(*[F.struct(F.lit(c).alias("run"), (F.col(c) + ceil_div(F.col("n"), 4)).alias("bytes")) for c in ("tableid", "colid", "rowid")])
    return per.select("n", F.explode(runs).alias("x")).groupBy("x.run").agg(F.sum("n").alias("n"), F.sum("x.bytes").alias("bytes"))
