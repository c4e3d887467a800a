"""Rows in an order, dealt to ranges that follow the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .store import written

#: Bits of monotonically_increasing_id() that count inside a partition.
_INSIDE = 33


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _part and _i: rows of a lower _part come first by `order` (which must be total), _i counts from 0 inside each.

    Spark takes the bounds of the ranges from a sample of the whole key and makes as many as the session has shuffle partitions, so keys with one
    beginning are spread too. The rows are written, so every reader sees the same ranges.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return written(placed.withColumn("_part", F.shiftright(number, _INSIDE)).withColumn("_i", number.bitwiseAND(F.lit((1 << _INSIDE) - 1))))


def before(parts: DataFrame, value: str, name: str) -> DataFrame:
    """parts(_part, value) with the sum of value over all lower parts; one row for each range."""
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(value).over(lower), F.lit(0)).cast("long").alias(name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a long column 0, 1, 2, ... by `order` (which must be total)."""
    rows = ranged(df, order)
    starts = before(rows.groupBy("_part").agg(F.count("*").alias("n")), "n", "_start")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def numbered_within(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """df with a long column 0, 1, 2, ... by `order` inside each value of `by`. One value may hold any share of the rows: it is spread over ranges, and
    only its counts in these are summed up."""
    rows = ranged(df, [by, *order])
    held = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    lower = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select(by, "_part", (F.coalesce(F.sum("_n").over(lower), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(shift, [by, "_part"]).withColumn(name, F.col("_i") + F.col("_shift")).drop("_part", "_i", "_shift")


def running(df: DataFrame, order: str | list[str], value: str) -> DataFrame:
    """df with `start`, the sum of value over all rows before it by order (unique)."""
    rows = ranged(df, [order] if isinstance(order, str) else order)
    starts = before(rows.groupBy("_part").agg(F.sum(value).alias("n")), "n", "_start")
    inside = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_sum", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "_part").withColumn("start", (F.col("_start") + F.col("_sum")).cast("long")).drop("_part", "_i", "_start", "_sum")


def latest(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the greatest value of the rows up to each one by `order` (total); null where there is none."""
    rows = ranged(df, order)
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy("_part").agg(F.max(value).alias("_m")).select("_part", F.max("_m").over(lower).alias("_b"))
    inside = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_in", F.max(value).over(inside)).join(F.broadcast(most), "_part")
    return found.withColumn(name, F.coalesce("_in", "_b")).drop("_part", "_i", "_in", "_b")
