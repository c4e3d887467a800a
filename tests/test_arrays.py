"""Arrays over several blocks of positions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import arrays
from lakeloom.ranges import numbered_within


@pytest.fixture
def held(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 8)
    rng = np.random.default_rng(3)
    held = {i: rng.integers(0, 100, n) for i, n in enumerate([1, 2, 4, 5, 7, 8, 9, 16, 17, 100])}
    held[20] = np.arange(30)
    rows = [(i, p, int(x)) for i, v in held.items() for p, x in enumerate(v)]
    return held, spark.createDataFrame(rows, "array_id long, pos long, v long").repartition(3)


def lists(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.array_id, []).append(r.v)
    return out


def test_deltas(held):
    want, df = held
    assert lists(arrays.delta(df)) == {i: np.diff(v, prepend=0).tolist() for i, v in want.items()}
    assert lists(arrays.undo_delta(arrays.delta(df))) == {i: v.tolist() for i, v in want.items()}
    strided = {i: np.diff(v, prepend=0) if len(v) <= 4 else np.concatenate([v[:4], v[4:] - v[:-4]]) for i, v in want.items()}
    assert lists(arrays.delta_stride(df)) == {i: v.tolist() for i, v in strided.items()}
    assert lists(arrays.undo_delta_stride(arrays.delta_stride(df))) == {i: v.tolist() for i, v in want.items()}
    assert lists(arrays.gaps(df, False)) == {i: np.diff(v).tolist() for i, v in want.items() if len(v) > 1}


def test_order_pieces_and_selection(held):
    want, df = held
    assert {r.array_id for r in arrays.unsorted_arrays(df).collect()} == {i for i, v in want.items() if (np.diff(v) < 0).any()}
    pieces = {(r.array_id, r.piece): r.a for r in arrays.as_pieces(df, 7).collect()}
    assert pieces == {(i, k // 7): v[k : k + 7].tolist() for i, v in want.items() for k in range(0, len(v), 7)}
    fit = sorted(i for i, v in want.items() if 4 <= len(v) <= 17)
    assert sorted(lists(arrays.selected(df, 4, 17, 3))) == fit[:3] and sorted(lists(arrays.selected(df, 4, 17))) == fit


def test_numbers_inside_hot_groups(spark):
    rows = [(0 if i % 3 else i % 5, i * 7919 % 4001) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, v long").repartition(5)
    got = numbered_within(df, "g", ["v"], "pos")
    for g in range(5):
        mine = got.where(F.col("g") == g).orderBy("v").collect()
        assert [r.pos for r in mine] == list(range(len(mine))) and [r.v for r in mine] == sorted(v for x, v in rows if x == g)
