"""Layouts as real bytes against plain Python over the same cells."""

import pytest

from lakeloom.functions import blocks as bytes_of
from lakeloom.operators import encoded, layouts
from lakeloom.operators.measure import stored_bytes

WORDS = ["", "a", "a", "a", "ab", "abacus", "b", "bé", "bell", "bells", "zoo", "0.5"]


@pytest.fixture(scope="module")
def cells(spark):
    # one text in a third of all cells, repeated over blocks of keys and over two pieces of rows
    rows = [("hot", 1, i % 3, i * 997) for i in range(150)] + [(f"{WORDS[i % 12]}{i % 7 or ''}", i % 4, i % 5, i * 31 + 5) for i in range(300)]
    return spark.createDataFrame(rows, "tokenized string, tableid long, colid long, rowid long"), rows


@pytest.mark.parametrize("name", layouts.LAYOUTS)
def test_lookup_reads_the_bytes(spark, cells, name):
    df, rows = cells
    index = encoded.build(df, name, keep=True)
    keys = ["hot", "", "a", "a1", "abacus3", "zoo", "zz", "!", "hot", "none"]
    got = encoded.lookup(index, spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in keys)
    assert stored_bytes(index) > 0
    index.drop()


@pytest.mark.parametrize("name", ["ns_arena", "frontcoding", "incr", "smaz+pfor+dedup"])
def test_round_trip_and_no_cells(cells, name):
    df, rows = cells
    assert sorted(map(tuple, encoded.round_trip(df, name).collect())) == sorted(rows)
    assert encoded.round_trip(df.limit(0), name).count() == 0


def test_slices_lie_in_their_arenas(cells, monkeypatch):
    monkeypatch.setattr(encoded, "ARENA", 256)
    index = encoded.build(cells[0], "pfor_split+dedup", keep=True)
    held = {r.arena_id: (r.base, bytes(r.data)) for r in index.arenas.collect()}
    slices = index.slices.orderBy("start").collect()
    assert len(held) > 3 and sum(len(d) for _, d in held.values()) == sum(s.length for s in slices)
    assert [s.start for s in slices] == [sum(t.length for t in slices[:i]) for i in range(len(slices))]
    for s in slices:
        base, data = held[s.arena_id]
        assert 0 <= s.start - base and s.start - base + s.length <= len(data)
    assert sorted(map(tuple, encoded.round_trip(cells[0], "pfor_split+dedup").collect())) == sorted(cells[1])


def test_sizes_of_learned_and_pfor_layouts(cells):
    df, rows = cells
    book = encoded.learn_book(df)
    lists = {}
    for text, *ids in sorted(rows):
        lists.setdefault((text, *ids[:2], ids[2] // 65536), []).extend(ids)
    once, each = sorted({r[0] for r in rows}), [r[0] for r in rows]
    short = lambda keys: sum(len(book.encode(k)) for k in keys)
    coded = lambda how: sum(len(bytes_of.encode_postings(v, how)) for v in lists.values())
    plain = sum(len(k.encode()) for k in once)
    want = {"smaz": (short(each), 13 * len(rows)), "smaz+dedup": (short(once), coded("plain")), "smaz+ns+dedup": (short(once), coded("gve")), "smaz+pfor+dedup": (short(once), coded("pfor")), "pfor+dedup": (plain, coded("pfor")), "pfor_split+dedup": (plain, coded("pfor_split"))}
    assert {r.layout: (r.key_bytes, r.posting_bytes) for r in encoded.real_sizes(df, list(want)).collect()} == want
    assert set(want) | set(layouts.MODELLED) == set(layouts.LAYOUTS)
