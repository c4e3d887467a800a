"""Gapless numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .store import written

#: Parts into which every group is dealt; a group of a third of 3e10 rows has parts of 1e7.
PARTS = 1024


def with_slots(df: DataFrame, group: str, order: list[str], name: str = "slot", parts: int = PARTS) -> DataFrame:
    """df with a long column of 0, 1, 2, ... inside each value of group.

    Rows are dealt to parts by a hash of `order`; numbers run part by part and by `order` inside a part, so no group is
    gathered in one task. The table of parts has (groups * parts) rows at most. group must not be null.
    """
    salted = written(df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")))
    counts = salted.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    numbered = salted.withColumn("_i", inside)
    return numbered.join(starts, [group, "_part"]).withColumn(name, (F.col("_start") + F.col("_i")).cast("long")).drop("_part", "_start", "_i")
