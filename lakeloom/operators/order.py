"""Sorting, checks of order, samples and array pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CELL_ORDER = ["tokenized", "tableid", "colid", "rowid"]


def sort_cells(cells: DataFrame) -> DataFrame:
    return cells.orderBy(*CELL_ORDER)


def violations(df: DataFrame, pos: str, value: str, parts: int = 4096) -> DataFrame:
    """(pos, prev, cur) where a value is less than the one before it by pos.

    pos runs without gaps, so a row's predecessor is found inside ranges of `parts` positions that overlap by one row.
    """
    block = F.floor(F.col(pos) / parts)
    again = F.floor((F.col(pos) + 1) / parts)
    dealt = df.select(F.col(pos).alias("pos"), F.col(value).alias("cur"), F.explode(F.array_distinct(F.array(block, again))).alias("_b"))
    prev = F.lag("cur").over(Window.partitionBy("_b").orderBy("pos"))
    return dealt.withColumn("prev", prev).where("prev > cur").select("pos", "prev", "cur").distinct()


def first_violation(df: DataFrame, pos: str, value: str) -> DataFrame:
    return violations(df, pos, value).orderBy("pos").limit(1)


def repeat_flags(cells: DataFrame) -> DataFrame:
    """(tableid, rows, repeated): how many cells of each table repeat the text before them when sorted by text."""
    firsts = cells.groupBy("tableid", "tokenized").agg(F.count("*").alias("n"))
    return firsts.groupBy("tableid").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"))


def hash_sample(cells: DataFrame, factor: float) -> DataFrame:
    """Cells kept by an arithmetic hash of their location; the same ones on every engine."""
    if not 0 < factor < 1:
        raise ValueError("a sample's factor lies between 0 and 1")
    return cells.where((F.col("tableid") * 31 + F.col("colid") * 17 + F.col("rowid") * 7919) % 10_000 < int(round(factor * 10_000)))


def random_sample(df: DataFrame, factor: float, seed: int = 7) -> DataFrame:
    """Rows kept with probability factor; 1 keeps all."""
    if factor < 1e-5 or factor > 1:
        raise ValueError("the factor is too small or above 1")
    return df if factor == 1 else df.sample(False, factor, seed)


def stored_factor(path: Column) -> Column:
    """The factor in a sample's name: what follows its last -, else 1."""
    found = F.regexp_extract(path, r"-([0-9]*\.?[0-9]+)$", 1)
    return F.when(found == "", F.lit(1.0)).otherwise(found.cast("double"))


def pick_sample(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, stored, remaining): for each wanted factor the least stored one that is not less, and the factor left to take."""
    best = wanted.join(stored, stored.factor >= wanted.wanted).groupBy("wanted").agg(F.min("factor").alias("stored"))
    return best.select("wanted", "stored", F.round(F.col("wanted") / F.col("stored"), 9).alias("remaining"))


def shuffle_in_blocks(df: DataFrame, pos: str, block: int, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """df in an order that is random inside each run of `block` positions and not across them; by: columns that tell arrays apart."""
    return df.withColumn("_b", F.floor(F.col(pos) / block)).withColumn("_r", F.rand(seed)).orderBy(*by, "_b", "_r").drop("_b", "_r")


def array_pieces(arrays: DataFrame, size: int = 65_536) -> DataFrame:
    """(array_id, piece, n) and the values of each array's pieces of at most `size`; arrays(array_id, a)."""
    starts = F.sequence(F.lit(0), F.size("a") - 1, F.lit(size))
    parts = arrays.where(F.size("a") > 0).select("array_id", F.posexplode(F.transform(starts, lambda i: F.slice("a", i + 1, F.lit(size)))).alias("piece", "a"))
    return parts.select("array_id", F.col("piece").cast("long").alias("piece"), F.size("a").cast("long").alias("n"), "a")


def length_between(arrays: DataFrame, least: int, most: int) -> DataFrame:
    return arrays.where(F.size("a").between(least, most))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by order: each task keeps n at most."""
    return df.orderBy(*order).limit(n)
