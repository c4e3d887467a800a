"""Inverted indexes over cells, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..ranges import numbered, running

#: Rows of a table that one piece of a posting list may cover.
PIECE = 65_536
LOCATION = ["tableid", "colid", "rowid"]


def location() -> Column:
    return F.struct(*LOCATION)


def summary(cells: DataFrame) -> DataFrame:
    """(tokenized, n, first and last location) of every text."""
    low, high = F.min(location()), F.max(location())
    held = cells.groupBy("tokenized").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"))
    return held.select("tokenized", "n", *[F.col(f"low.{c}").alias(f"min_{c}") for c in LOCATION], *[F.col(f"high.{c}").alias(f"max_{c}") for c in LOCATION])


def pieces(cells: DataFrame, size: int = PIECE) -> DataFrame:
    """(tokenized, tableid, colid, piece, locs): sorted location lists, in pieces by column and range of rows.

    A text that is in a third of all cells has many pieces of at most `size` locations (if cells are distinct), never one list.
    """
    grouped = cells.withColumn("piece", F.floor(F.col("rowid") / size)).groupBy("tokenized", "tableid", "colid", "piece")
    return grouped.agg(F.array_sort(F.collect_list(location())).alias("locs"))


def ordered_pieces(cells: DataFrame) -> DataFrame:
    """pieces, sorted by text: the layout for range pruning on disk."""
    return pieces(cells).orderBy("tokenized", "tableid", "colid", "piece")


def exploded(index: DataFrame) -> DataFrame:
    """The cells that an index holds."""
    return index.select("tokenized", F.explode("locs").alias("l")).select("tokenized", *[F.col(f"l.{c}").alias(c) for c in LOCATION])


def flat_ints(cells: DataFrame) -> DataFrame:
    """(tokenized, n_ints, total): of each text's locations as one list of integers, its length and sum."""
    return cells.groupBy("tokenized").agg((F.count("*") * 3).alias("n_ints"), F.sum(F.col("tableid") + F.col("colid") + F.col("rowid")).alias("total"))


def flat_lists(cells: DataFrame) -> DataFrame:
    """(tokenized, tableid, colid, piece, ints): each piece's locations as one list of integers, three for each location."""
    ids = lambda x: F.array(x.tableid, x.colid, x.rowid)
    return pieces(cells).select("tokenized", "tableid", "colid", "piece", F.flatten(F.transform("locs", ids)).alias("ints"))


def triples(cells: DataFrame) -> DataFrame:
    """Locations as lists of three integers, and back."""
    return cells.select("tokenized", F.array(*LOCATION).alias("ints")).select("tokenized", *[F.element_at("ints", i + 1).alias(c) for i, c in enumerate(LOCATION)])


def entry_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tableid").agg(F.count("*").alias("cells"))


def lookup(cells: DataFrame, key: str) -> DataFrame:
    """All locations of one text; empty if there are none."""
    return cells.where(F.col("tokenized") == key)


def occurrences(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n) for each of keys(key): its number of cells, 0 if absent."""
    counts = cells.groupBy("tokenized").agg(F.count("*").alias("n"))
    return keys.join(counts, keys.key == counts.tokenized, "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def lookup_batch(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """All locations of each of keys(key). A few keys are broadcast by size; many are joined by a shuffle, as Spark sees fit."""
    return keys.join(cells, keys.key == cells.tokenized).select("key", *LOCATION)


def missing(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of keys(key) that no cell holds."""
    return keys.join(cells, keys.key == cells.tokenized, "left_anti")


def text_positions(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, first_pos, last_pos): where each key's run lies in the cells sorted by text.

    A running sum over texts' counts gives starts, so cells are never numbered one by one. The sum goes over ranges of texts.
    """
    counts = cells.groupBy("tokenized").agg(F.count("*").alias("n"))
    starts = running(counts, "tokenized", "n")
    return keys.join(starts, keys.key == starts.tokenized).select("key", F.col("start").alias("first_pos"), (F.col("start") + F.col("n") - 1).alias("last_pos"))


def positions(df: DataFrame, order: str) -> DataFrame:
    """df(order unique) with pos, its place by order from 0."""
    return numbered(df, [order], "pos")


def sampled_keys(cells: DataFrame, n: int = 10_000, seed: int = 7) -> DataFrame:
    """About n distinct texts by chance (all, if there are fewer), in random order."""
    keys = cells.select(F.col("tokenized").alias("key")).distinct()
    return keys.sample(min(1.0, n / max(1, keys.count())), seed).orderBy(F.rand(seed))


def keys_at(cells: DataFrame, n: int, step: int) -> DataFrame:
    """(draw, pos, key): n draws with replacement from the distinct texts by position, (draw * step) mod their number."""
    keys = positions(cells.select("tokenized").distinct(), "tokenized")
    total = keys.agg(F.count("*").alias("m"))
    draws = cells.sparkSession.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(total)).select("draw", (F.col("draw") * step % F.col("m")).alias("pos"))
    return draws.join(keys, "pos").select("draw", "pos", F.col("tokenized").alias("key"))
