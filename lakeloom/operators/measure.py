"""Measuring an index layout: build it as bytes, look keys up in it, report size and times."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from .encoded import Index, build, lookup
from .index import sampled_keys
from .layouts import layout


def stored_bytes(index: Index) -> int:
    """Bytes of coded keys and payloads."""
    return index.bundles.agg(F.sum(F.octet_length("keys").cast("long") + F.octet_length("payloads"))).first()[0] or 0


def measure(cells: DataFrame, name: str, table: str, keys: int = 10_000, multi_proc: bool = False, label: str = "") -> DataFrame:
    """One measurement record of a layout over cells. The index is written, its bytes are counted, and keys are looked up in what was
    written; the mean lookup time is the batch's time divided by its number of keys. The index is deleted in the end."""
    layout(name)
    spark = cells.sparkSession
    total = cells.count()
    began = time.perf_counter_ns()
    index = build(cells, name, keep=True)
    built = time.perf_counter_ns() - began
    chosen = sampled_keys(cells, keys)
    wanted = chosen.count()
    began = time.perf_counter_ns()
    lookup(index, chosen).write.format("noop").mode("overwrite").save()
    looked = (time.perf_counter_ns() - began) // max(1, wanted)
    row = (total, stored_bytes(index), built, built, looked, name, table, multi_proc, label)
    index.drop()
    return spark.createDataFrame([row], "cells long, bytes long, build_duration_nanosec long, build_duration_total_nanosec long, retr_duration_avg_nanosec long, algorithm string, table string, multi_proc boolean, label string")
