"""The queries over all tables against their SQL on cells that are built without Spark."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e
from lakeloom.plans import catalogue
from lakeloom.sources import lake
from tests.parity import connection, difference


def plain(x) -> str:
    """A float as the JVM prints it."""
    x = np.float32(x)
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return np.format_float_positional(x, unique=True, trim="0")
    digits, power = np.format_float_scientific(x, unique=True, trim="0").split("e")
    return f"{digits}E{int(power)}"


def text(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(plain, v)) + "]"
    if isinstance(v, float):
        return str(Decimal(repr(v)).quantize(Decimal("0.01")))
    if hasattr(v, "microsecond"):
        return str(v.replace(microsecond=0)) + f".{v.microsecond:06d}".rstrip("0").rstrip(".")
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    rows = []
    for t, name in enumerate(lake.TABLES):
        df = pq.read_table(f"{sf_dir}/{name}.parquet")
        held = df.to_pylist()
        if name in lake.ORDER_OF:
            held.sort(key=lambda r, n=name: tuple(r[c] for c in lake.ORDER_OF[n]))
        for i, r in enumerate(held):
            rows += [(text(r[c]), t, k, r[lake.KEY_OF[name]] if name in lake.KEY_OF else i) for k, c in enumerate(df.column_names) if r[c] is not None]
    con = connection(sf_dir)
    whole = pd.DataFrame(rows, columns=["tokenized", "tableid", "colid", "rowid"])
    con.register("whole", whole)
    con.execute("CREATE TABLE every AS SELECT * FROM whole")
    return con


CHECKED = ["lake_cells", "lake_entry_count", "idx_dedup", "idx_pieces", "lookup_single", "lookup_batch", "lookup_positions", "count_occurrences", "keys_sample_positions", "profile_info", "hist_bitwidth_rows", "sort_order_rank", "sample_hash_10pct", "dict_blocks", "dict_front_bytes", "dict_lookup_block", "posting_vbyte_bytes", "arena_offsets", "layout_summary", "layout_roundtrip_pfor_split+dedup", "layout_roundtrip_smaz+dedup", "lookup_encoded", "lookup_in_front_blocks", "idx_flat_lists", "ext_column_overlap"]


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf_dir, con, name):
    sql = e.oracle_sql()[name]
    sql = "SELECT * FROM every" if name == "lake_cells" else sql.replace(catalogue.CELLS, "cells AS (SELECT * FROM every)")
    assert difference(e.queries()[f"{name}_all"](spark, sf_dir), con, sql) == ""


def test_every_table(spark, sf_dir):
    got = {r.tableid for r in e.queries()["lake_entry_count_all"](spark, sf_dir).collect()}
    assert got == set(range(len(lake.TABLES))) and set(lake.COLUMNS_OF) == set(lake.TABLES)
    assert catalogue._tables.get() is lake.DEFAULT
