import os

import pytest

import __spark_entry__ as e
from tests.parity import connection, difference

SQL = {k: v for k, v in e.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, sf_dir, con, name):
    assert difference(e.queries()[name](spark, sf_dir), con, SQL[name]) == ""


def test_registered():
    assert set(SQL) < set(e.queries())
    assert os.path.isdir("/root/testdata/sf0.001")


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_position_has_a_key(spark, sf_dir, con):
    got = [r.pos for r in e.queries()["dict_key_at"](spark, sf_dir).collect()]
    assert sorted(got) == list(range(con.execute(f"SELECT count(*) FROM ({SQL['idx_dedup']})").fetchone()[0]))


def test_every_array_is_shuffled_in_blocks(spark, sf_dir):
    rows = e.queries()["shuffle_in_blocks"](spark, sf_dir).collect()
    blocks = [(r.array_id, r.pos // 16) for r in rows]
    assert blocks == sorted(blocks) and {a for a, _ in blocks} == set(range(32))
    assert all([r.pos for r in rows if r.array_id == a] != sorted(r.pos for r in rows if r.array_id == a) for a in range(32))


def test_every_column_is_counted(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/lineitem.parquet").columns
    rows = e.queries()["column_cardinality_order"](spark, sf_dir).collect()
    assert {r.name for r in rows} == set(names) and len(rows) == len(names)
    assert e.queries()["total_attribute_values"](spark, sf_dir).first().total_values == sum(r.card for r in rows)
