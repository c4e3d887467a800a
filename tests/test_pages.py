"""Packed rows dealt out in pages, and columns handed to Python as numbers."""

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import encoded, pages
from lakeloom.sources import lake


def test_what_begins_like_a_bound_is_compared_with_it():
    rng = np.random.default_rng(3)
    texts = ["", "a", "a\0", "customer", "customer#1", "customer#2", "customer#10", "é", "zz"]
    rows = [(texts[i].encode(), int(t), 2, int(p)) for i, t, p in zip(rng.integers(0, 9, 400), rng.integers(0, 3, 400), rng.integers(0, 4, 400), strict=True)]
    for n in (0, 1, 7, 40):
        keys = sorted(set(rows[:n]))
        got = pages.Bounds(keys).parts(pa.array([r[0].decode() for r in rows]), [np.array(x) for x in list(zip(*rows, strict=True))[1:]])
        assert got.tolist() == [bisect_right(keys, r) for r in rows]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_numbers_become_the_text_that_spark_prints(spark, zone):
    x = [0.1, -0.0, 1.005, -1.005, 2.675, 123456789.12, -0.05, 1e12 + 0.01, 9e14, 0.004999, -0.004, 1e13, 99999999999.99, None, 0.29, -1234.5, 1e-320]
    first = spark.createDataFrame(list(enumerate(x)), "c_custkey long, c_acctbal double").selectExpr("c_custkey", "'n' AS c_name", "CAST(-c_custkey AS int) AS c_nationkey", "c_acctbal", "'' AS c_mktsegment")
    stamps = ["2020-01-01 00:00:00", "2020-01-01 00:00:00.1", "0999-12-31 23:59:59.000001", "1960-05-05 10:10:10.12345", "9999-12-31 23:00:00", "1000-01-01 00:00:00", None, "2021-11-07 01:30:00"]
    second = spark.createDataFrame(list(enumerate(stamps)), "event_id long, s string").selectExpr("event_id", "CAST(s AS timestamp_ntz) AS ts", "-event_id AS user_id", "s AS event_type", "1.5D AS value", "CAST(NULL AS string) AS props")
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for events in (second, second.withColumn("ts", F.col("ts").cast("timestamp"))):
            tables = [lake.Wide("customer", first, F.col("c_custkey")), lake.Wide("events", events, F.col("event_id"))]
            assert sorted(map(tuple, encoded.round_trip_tables(tables, "ns+dedup").collect())) == sorted(map(tuple, lake.cells_of(tables).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


@pytest.mark.parametrize("name", ["ns", "vbyte+arena+ns+dedup", "incr_adv+dedup+ns_adv"])
def test_round_trips_over_many_ranges(spark, sf_dir, monkeypatch, name):
    for k, v in {"RANGE": 20_000, "SAMPLE": 40, "SAMPLE_LONG": 15, "DEAL": 300}.items():
        monkeypatch.setattr(pages, k, v)
    tables = lake.wide(spark, sf_dir, ["nation", "customer", "part", "documents", "labels"])
    got = encoded.round_trip_tables(tables, name)
    assert got.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lake.cells_of(tables).collect()))


def test_rows_are_packed_once(spark, sf_dir):
    # Spark's own ranges are made of a sample of what was packed, for which all rows are packed a first time
    plan = encoded.round_trip_tables(lake.wide(spark, sf_dir), "ns")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange") == 1


def test_tables_without_rows(spark, sf_dir):
    tables = [lake.Wide(t.name, t.rows.limit(0), t.rowid) for t in lake.wide(spark, sf_dir, ["nation", "documents"])]
    assert encoded.round_trip_tables(tables, "ns").count() == 0


@pytest.mark.parametrize("ranges", [1, 9])
def test_rows_without_a_key_are_numbered_by_their_order(spark, sf_dir, monkeypatch, ranges):
    if ranges > 1:
        for k, v in {"RANGE": 20_000, "SAMPLE": 300, "DEAL_BYTES": 50_000}.items():
            monkeypatch.setattr(pages, k, v)
    order = lake.ORDER_OF["lineitem"]
    odd = [(1, 1, 0.005, "2020-01-01"), (1, 1, None, "2020-01-01"), (1, 1, -7.125, "2020-01-01"), (1, 1, -7.12, "2020-01-01"), (1, 1, 3.0, "0020-01-01"), (1, 1, 3.0, None), (None, 1, 3.0, None), (1, None, 3.0, None), (-5, 1, 3.0, "2020-01-01")]
    rest = {"l_partkey": "1L", "l_suppkey": "2L", "l_quantity": "0.5D", "l_discount": "0D", "l_tax": "0D", "l_returnflag": "'a'", "l_linestatus": "'b'"}
    rows = spark.createDataFrame(odd, "l_orderkey long, l_linenumber int, l_extendedprice double, day string").withColumns({"l_shipdate": F.expr("CAST(day AS timestamp_ntz)")} | {k: F.expr(v) for k, v in rest.items()}).drop("day")
    for df in (rows, rows.unionByName(lake.table(spark, sf_dir, "lineitem").select(rows.columns).limit(4_000))):
        held = lake.numbered(df, order, "rowid")
        want = lake.Wide("lineitem", held, F.col("rowid")).cells.collect()
        got = encoded.round_trip_tables([lake.Wide("lineitem", held.drop("rowid"), F.lit(0), tuple(order))], "ns").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rows_are_numbered_without_a_written_copy(spark, sf_dir, monkeypatch):
    import __spark_entry__ as e
    from lakeloom import ranges

    want = e.queries()["lake_entry_count_all"](spark, sf_dir).collect()
    monkeypatch.setattr(ranges, "written", None)
    got = e.queries()["layout_roundtrip_ns_all"](spark, sf_dir).groupBy("tableid").agg(F.count("*").alias("cells"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_the_sizes_and_lookups_of_tables_pack_rows_once(spark, sf_dir, monkeypatch):
    from lakeloom.operators import layouts

    for k, v in {"RANGE": 20_000, "SAMPLE": 40, "SAMPLE_LONG": 15, "DEAL": 300}.items():
        monkeypatch.setattr(pages, k, v)
    tables = lake.wide(spark, sf_dir, ["nation", "customer", "documents", "conversations"], number=False)
    plan = encoded.coded(tables, "ns_arena", None)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    cells = lake.cells(spark, sf_dir, ["nation", "customer", "documents", "conversations"])
    want = sorted(map(tuple, layouts.modelled_sizes(cells).collect()))
    assert sorted(map(tuple, layouts.modelled_sizes(tables).collect())) == want
    keys = spark.createDataFrame([("ASIA",), ("BUILDING",), ("1",), ("user",), ("nowhere",)], "key string")
    got = encoded.lookup(encoded.build(tables, "ns_arena"), keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cells.join(keys.withColumnRenamed("key", "tokenized"), "tokenized").select("tokenized", "tableid", "colid", "rowid").collect()))


@pytest.mark.parametrize("runs", [0, 64])
def test_a_lookup_reads_only_the_row_groups_it_asks_for(spark, sf_dir, monkeypatch, runs):
    monkeypatch.setattr(encoded, "ASKED_RUNS", runs)
    bundles = spark.range(100).withColumnRenamed("id", "bundle_id")
    asked = spark.createDataFrame([(3,), (4,), (5,), (9,), (1 << 40,)], "bundle_id long")
    left = [r.bundle_id for r in encoded._only(bundles, asked).collect()]
    assert sorted(left) == ([3, 4, 5, 9] if runs else list(range(100)))
    assert encoded._only(bundles, asked.limit(0)) is bundles


def test_keys_in_one_place_are_not_compared(monkeypatch):
    from lakeloom.functions import batches
    from lakeloom.operators import layouts

    compared, plain = [], batches.shared
    monkeypatch.setattr(batches, "shared", lambda data, a, na, b, nb: compared.append(len(a)) or plain(data, a, na, b, nb))
    data, start, size = np.frombuffer(b"abcabd", np.uint8), np.array([0] * 7 + [3] * 9), np.full(16, 3)
    alone = layouts.model_key_bytes("incr", batches.runs(batches.joined((data, start, size))), np.array([0, 8]))
    assert layouts.model_key_bytes("incr", (data, start, size), np.array([0, 8])) == alone == 2 * 4 + 13 * 2 + 3
    assert compared[-1] == 1
