"""Connected components over an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import dropped, written


def _around(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges(a long, b long); comp is the smallest node reachable.

    Alternates large-star and small-star steps: every node hands its larger, then its smaller neighbours to the smallest node
    that it knows; this settles after a number of rounds in the order of the square of the logarithm of the number of nodes. Each step is one
    aggregation and one join and is written out, so an executor that is lost costs one step. The result is written too.
    Loops and repeated edges count once, edges with a null end not at all; an empty table gives an empty table.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, before = _mark(edges), None
    while mark[0] and mark != before:
        both = _around(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b")
        new = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        dropped(edges)
        edges, before, mark = new, mark, _mark(new)
    labels = edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    out = written(labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))
    dropped(edges)
    return out
