"""Sorted key dictionaries in blocks: positions, front and incremental coding sizes, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.bits import shared_prefix, varint_bytes
from ..ranges import latest
from .index import positions


def blocks(keys: DataFrame, size: int = 16) -> DataFrame:
    """(key, pos, block_id, place) of distinct keys(key): block_id is pos div size, place is pos mod size."""
    found = positions(keys, "key")
    return found.select("key", "pos", F.floor(F.col("pos") / size).cast("long").alias("block_id"), (F.col("pos") % size).alias("place"))


def block_heads(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("block_id").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def front_sizes(dictionary: DataFrame) -> DataFrame:
    """(block_id, prefix, bytes): one prefix for the block, then the rest of each key, all with varint lengths.

    The keys of a block are sorted, so its prefix is that of the first and the last.
    """
    prefix = dictionary.groupBy("block_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).select("block_id", shared_prefix(F.col("a"), F.col("b")).alias("prefix"))
    rest = F.octet_length("key") - F.col("prefix")
    sized = dictionary.join(prefix, "block_id").groupBy("block_id", "prefix").agg(F.sum(varint_bytes(rest) + rest).alias("rest"))
    return sized.select("block_id", "prefix", (varint_bytes(F.col("prefix")) + F.col("prefix") + F.col("rest")).cast("long").alias("bytes"))


def incremental_sizes(dictionary: DataFrame) -> DataFrame:
    """(block_id, shared, bytes): the first key whole, then for each key the length shared with the one before and the rest."""
    before = F.lag("key").over(Window.partitionBy("block_id").orderBy("pos"))
    held = dictionary.select("block_id", "key", before.alias("prev")).withColumn("lcp", shared_prefix(F.col("key"), F.col("prev")))
    size = F.octet_length("key")
    rest = size - F.col("lcp")
    bytes_ = F.when(F.col("prev").isNull(), varint_bytes(size) + size).otherwise(varint_bytes(F.col("lcp")) + varint_bytes(rest) + rest)
    return held.groupBy("block_id").agg(F.sum("lcp").alias("shared"), F.sum(bytes_).cast("long").alias("bytes"))


def find(dictionary: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, block_id, pos) of those of probes(key) that the dictionary holds.

    A probe's block is the last one whose first key is not greater. First keys and different probes are put in one order and dealt to
    ranges; a probe with no first key before it in its range takes the last block of the ranges before. Then the block is
    searched by an equi-join.
    """
    heads = block_heads(dictionary).select(F.col("first_key").alias("key"), F.col("block_id").alias("blk"), F.lit(0).alias("flag"))
    mixed = heads.unionByName(probes.select("key").distinct().select("key", F.lit(None).cast("long").alias("blk"), F.lit(1).alias("flag")))
    placed = latest(mixed, ["key", "flag"], "blk", "block_id").where("flag = 1").select("key", "block_id")
    found = placed.join(dictionary.select("block_id", "key", "pos"), ["block_id", "key"])
    return probes.select("key").join(found, "key").select("key", "block_id", "pos")


def key_at(dictionary: DataFrame, places: DataFrame) -> DataFrame:
    """(pos, key) of places(pos); places outside have no row."""
    return places.join(dictionary, "pos").select("pos", "key")


def with_values(dictionary: DataFrame, values: DataFrame) -> DataFrame:
    """(pos, key, value): the value vector beside the keys; values(key, value)."""
    return dictionary.join(values, "key").select("pos", "key", "value")
