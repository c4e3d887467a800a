"""Queries over whole tables, one for each operator of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat, decontamination, html_extraction, licences, packing, search, sharding, token_counts, toxicity
from .ngram_join import ngram_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Queries start here, so the package goes to the workers too."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document whose id is divisible by 50 against all documents, the 10 best."""
    docs = table(spark, sf_dir, "documents")
    return search.search(docs.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text"), docs, 10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 buckets over the words of all documents, batches of 65,536 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts hold control strings; digests read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(turns))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice coefficient of 0.8 or more."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the public 32k vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard similarity of 0.9 or more."""
    return ngram_join(table(spark, sf_dir, "documents"), 3, 9, 10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a chain trained on the labels."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    return decontamination.find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by a model trained on some of them."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_search, op2_packing, op3_chat_formatting, op4_licence_scan, op5_sharding, op6_token_counts, op7_ngram_join, op8_toxicity, op9_decontamination, op10_html_extraction)
}

ORACLES: dict[str, str] = {
    "op4_licence_scan": licences.oracle(),
}
