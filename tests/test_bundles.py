"""Bundles that end inside blocks of keys, keys and lists; one shuffle for a round trip."""

import numpy as np
import pytest

from lakeloom.functions import blocks as bytes_of
from lakeloom.operators import encoded, layouts


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("hot", 1, i % 2, i * 3) for i in range(300)] + [(f"{'x' * (i % 90)}{i % 41}", i % 4, i % 5, i * 31 + 5) for i in range(200)] + [("é", 0, 0, 7), ("", 0, 0, 7)]
    return spark.createDataFrame(rows, "tokenized string, tableid long, colid long, rowid long").repartition(3), rows


def expected(rows):
    """Key and posting bytes of each layout by the coders of one block and one list."""
    rows = sorted(rows, key=lambda r: (r[0].encode(), *r[1:]))
    lists = {}
    for text, *ids in rows:
        lists.setdefault((text, *ids[:2], ids[2] // 65536), []).extend(ids)
    each = [r[0] for r in rows]
    once = list(dict.fromkeys(each))
    out = {}
    for name, x in layouts.LAYOUTS.items():
        if name not in layouts.MODELLED:
            continue
        keys, n = (once if x.once else each), max(1, x.block)
        blocks = [keys[i : i + n] for i in range(0, len(keys), n)]
        code = {"plain": lambda k: k[0].encode(), "front": bytes_of.front, "incr": bytes_of.incremental}[x.keys]
        posted = list(lists.values()) if x.once else [list(r[1:]) for r in rows]
        out[name] = (len(rows), len(keys), len(blocks), len(posted), sum(len(code(b)) for b in blocks), sum(len(bytes_of.encode_postings(p, x.postings)) for p in posted))
    return out


@pytest.mark.parametrize("full", [7, 50, 1 << 16])
def test_sizes_over_the_edges_of_bundles(cells, monkeypatch, full):
    monkeypatch.setattr(encoded, "BUNDLE", full)
    want = expected(cells[1])
    assert {r[0]: tuple(r[1:]) for r in encoded.real_sizes(cells[0], layouts.MODELLED).collect()} == want
    assert {r[0]: tuple(r[1:]) for r in layouts.modelled_sizes(cells[0]).collect()} == want


@pytest.mark.parametrize("name", ["ns+dedup", "ns", "ns_arena", "pfor_split+dedup", "smaz", "smaz+ns+dedup", "incr_adv+dedup+ns_adv", "pfor+dedup", "vbyte+arena+ns+dedup", "frontcoding"])
def test_round_trips_and_lookups_over_the_edges_of_bundles(spark, cells, monkeypatch, name):
    monkeypatch.setattr(encoded, "BUNDLE", 20)
    df, rows = cells
    assert sorted(map(tuple, encoded.round_trip(df, name).collect())) == sorted(rows)
    index = encoded.build(df, name, keep=True)
    assert index.bundles.count() > 20
    keys = ["hot", "", "é", "x1", "zzz"]
    got = encoded.lookup(index, spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in keys)
    index.drop()


@pytest.mark.parametrize("name", ["ns", "ns+dedup", "pfor_split+dedup", "incr_adv+dedup+ns_adv"])
def test_a_round_trip_shuffles_once(cells, name):
    plan = encoded.round_trip(cells[0].coalesce(1), name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Join" not in plan
    assert np.all([c not in plan for c in ("hashpartitioning", "Window")])


def test_cells_of_one_text_and_piece_share_a_row_before_the_shuffle(spark):
    rows = [(f"{i % 3}", 1, 2, i) for i in range(70_000)]
    df = spark.createDataFrame(rows, "tokenized string, tableid long, colid long, rowid long").coalesce(1)
    got = encoded.packed(df).collect()
    assert len(got) <= 9 and sum(len(r.rows) for r in got) == 140_000
    back = [(r.tokenized, r.tableid, r.colid, r.piece * 65_536 + x) for r in got for x in np.frombuffer(r.rows, "<u2").tolist()]
    assert sorted(back) == sorted(rows)


@pytest.mark.parametrize(("pack", "size"), [(1, 1 << 20), (13, 50), (1 << 17, 4 << 20)])
def test_packed_rows_are_put_together_in_order(spark, monkeypatch, pack, size):
    monkeypatch.setattr(encoded, "PACK", pack)
    monkeypatch.setattr(encoded, "PACK_BYTES", size)
    big = 1 << 40  # the four ranges do not fit one integer
    rows = [("a", 1, 2, i * 40_000 % 200_003) for i in range(90)] * 2 + [("b" * (i % 9), i % 2 * big, i % 3 * big, i) for i in range(60)] + [("long" * 90_000, 3, i % 2, i) for i in range(20)]
    df = spark.createDataFrame(rows, "tokenized string, tableid long, colid long, rowid long").repartition(4)
    placed = encoded.packed(df).repartitionByRange(2, *encoded._PACKED_ORDER).sortWithinPartitions(*encoded._PACKED_ORDER)
    assert [tuple(r) for r in placed.mapInArrow(encoded._unpacked, encoded._CELLS).collect()] == sorted(rows)


@pytest.mark.parametrize("keys", [5, 400])
def test_the_book_is_learned_from_the_keys_with_the_least_hash(cells, monkeypatch, keys):
    from pyspark.sql import functions as F

    monkeypatch.setattr(encoded, "BOOK_KEYS", keys)
    held = cells[0].select("tokenized", F.xxhash64("tokenized").alias("h")).distinct().orderBy("h", "tokenized").limit(keys).collect()
    assert encoded.learn_book(cells[0]).book == bytes_of.ShortStrings.learned([r.tokenized for r in held]).book


@pytest.mark.parametrize("pack", [7, 1 << 17])
def test_rows_of_tables_are_packed_by_column(spark, sf_dir, monkeypatch, pack):
    from pyspark.sql import functions as F

    from lakeloom.sources import lake

    monkeypatch.setattr(encoded, "PACK", pack)
    found = lake.wide(spark, sf_dir, ["nation", "customer", "labels"])
    # some nulls, some rowids far apart, one column without a text
    rows = found[1].rows.withColumn("c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name"))).withColumn("c_mktsegment", F.lit(None).cast("string"))
    found[1] = lake.Wide("customer", rows, F.col("c_custkey") * F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(1 << 45))
    got = encoded.packed_tables(found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    back = [(r.tokenized, r.tableid, r.colid, r.piece * 65_536 + x) for r in got.collect() for x in np.frombuffer(r.rows, "<u2").tolist()]
    want = sorted(map(tuple, lake.cells_of(found).collect()))
    assert sorted(back) == want
    if pack > 7:
        # 25 regions of nations in 5 rows, 25 nations of customers in few
        assert got.where("tableid = 1 AND colid = 2").count() == 5
    assert sorted(map(tuple, encoded.round_trip_tables([found[0], found[2]], "pfor+dedup").collect())) == [w for w in want if w[1] != 2]
