"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.decontamination import without_copies
from lakeloom.llm.ngram_join import keep_one
from lakeloom.llm.packing import pack
from lakeloom.llm.store import written
from lakeloom.llm.toxicity import without_toxic
from lakeloom.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier chain, trained on the labels, calls toxic.

    Each row is judged by its own text, a null one as empty; repeated rows and null ids fare alike. Without labels nothing is dropped.
    An empty table gives an empty table. All columns stay, extra ones with any name too.
    """
    ship(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more)."""
    ship(spark)
    return keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a copy, exact or edited, of a benchmark item."""
    ship(spark)
    return without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of the remaining documents."""
    ship(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_test_items),
    ("packing", pack_texts),
]

#: The classifier, the join and the alignment can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
