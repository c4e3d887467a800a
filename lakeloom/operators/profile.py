"""Profiles, histograms and entropies of cells and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bits import width, width_least_one
from .arrays import delta, selected


def info(cells: DataFrame) -> DataFrame:
    """One row: rows, distinct texts, mean cardinality, mean bytes of text, mean ids."""
    by_text = cells.groupBy("tokenized").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tableid", "colid", "rowid")])
    held = by_text.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_values"), F.sum(F.octet_length("tokenized") * F.col("n")).alias("bytes"), *[F.sum(c).alias(c) for c in ("tableid", "colid", "rowid")])
    share = lambda c: F.round(F.col(c).cast("double") / F.col("rows"), 6)
    return held.select("rows", "distinct_values", F.round(F.col("rows").cast("double") / F.col("distinct_values"), 6).alias("mean_cardinality"), share("bytes").alias("mean_text_bytes"), *[share(c).alias(f"mean_{c}") for c in ("tableid", "colid", "rowid")])


def linear_histogram(df: DataFrame, value: str, bins: int = 256, span: int = 16) -> DataFrame:
    """(bin, n) for every bin; the last one takes all greater values."""
    counts = df.groupBy(F.least(F.floor(F.col(value) / span), F.lit(bins - 1)).cast("long").alias("bin")).count()
    return _all_bins(df, counts, "bin", 0, bins)


def width_histogram(df: DataFrame, value: str, bins: int = 64) -> DataFrame:
    """(width, n) for widths 1 to bins; 0 has width 1."""
    counts = df.groupBy(width_least_one(F.col(value)).alias("width")).count()
    return _all_bins(df, counts, "width", 1, bins + 1)


def _all_bins(df: DataFrame, counts: DataFrame, name: str, first: int, past: int) -> DataFrame:
    bins = df.sparkSession.range(first, past).select(F.col("id").alias(name))
    return bins.join(F.broadcast(counts), name, "left").select(name, F.coalesce("count", F.lit(0)).alias("n"))


def shares(values: DataFrame, value: Column, name: str = "width") -> DataFrame:
    """(name, n, share) of each value of an expression."""
    counts = values.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", F.round(F.col("n").cast("double") / F.col("total"), 9).alias("share"))


def entropy(values: DataFrame, value: str) -> DataFrame:
    """One row: (n, shannon, databits), Shannon entropy in bits and mean bit width."""
    counts = values.groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    p = F.col("c").cast("double") / F.col("t").cast("double")
    return counts.crossJoin(F.broadcast(total)).agg(F.sum("c").alias("n"), F.round(-F.sum(p * F.log2(p)), 6).alias("shannon"), F.round(F.sum(p * width(F.col(value))), 6).alias("databits"))


def max_bits(values: DataFrame, block: str, value: str) -> DataFrame:
    """(block, bits): the width of all values of a block or-ed together."""
    return values.groupBy(block).agg(width(F.bit_or(value)).alias("bits"))


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_idx, name, card) of each column, in one pass."""
    one = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("card")) for c in columns])).alias("col_idx", "x")).select(F.col("col_idx").cast("long").alias("col_idx"), "x.name", "x.card")


def total_values(cards: DataFrame) -> DataFrame:
    return cards.agg(F.sum("card").alias("total_values"))


def below_top(cards: DataFrame, k: int, least: int = 0) -> DataFrame:
    """Columns whose cardinality is below the k-th greatest (and below `least` at any rate)."""
    bound = cards.agg(F.greatest(F.element_at(F.sort_array(F.collect_list("card"), False), k), F.lit(least)).alias("bound"))
    return cards.crossJoin(F.broadcast(bound)).where("card < bound").select("col_idx", "name", "card")


def frequency_codes(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, code): 0 for the most frequent value of a group; ties by value, the greater first."""
    counts = values.groupBy(group, value).count()
    return counts.select(group, value, (F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), F.desc(value))) - 1).cast("long").alias("code"))


def domain_codes(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, code): the rank of each distinct value of a group."""
    return values.select(group, value).distinct().select(group, value, (F.row_number().over(Window.partitionBy(group).orderBy(value)) - 1).cast("long").alias("code"))


def entropy_of_arrays(a: DataFrame, with_delta: bool = True, least: int = 2, count: int | None = None) -> DataFrame:
    """One row (arrays, n, shannon, databits) of arrays a(array_id, pos, v): those with `least` values or more, the `count` first of these by
    array_id; by default of the differences of neighbours, the first value staying."""
    held = selected(a, least, None, count)
    bits = entropy(delta(held) if with_delta else held, "v")
    return held.agg(F.count_distinct("array_id").alias("arrays")).crossJoin(bits)
