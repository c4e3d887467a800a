import random

import pytest

from lakeloom.functions.blocks import ShortStrings, decode_postings, encode_postings, front, incremental, shared, unfront, unincremental

PAIRS = [("harbour", "hard", 3), ("lantern", "orchard", 0), ("mill", "moss", 1), ("xylem", "yxlem", 0), ("fern", "fern", 4), ("cloudberry", "cloud", 5), ("cloud", "cloudberry", 5), ("", "reed", 0), ("Élan", "Élite", 3)]


@pytest.mark.parametrize(("a", "b", "n"), PAIRS)
def test_shared(a, b, n):
    assert shared(a.encode(), b.encode()) == n


def test_incremental_bytes():
    # length of the first key and the key, then for each key the bytes shared with the one before, those left, and these
    assert incremental(["birch", "birdsong"]) == b"\x05birch" + b"\x03\x05dsong"
    assert incremental(["birch", "birdsong", "bis"]) == incremental(["birch", "birdsong"]) + b"\x02\x01s"
    for keys in (["birch", "birdsong", "bis"], [""], ["", "é", "éa"], []):
        assert unincremental(incremental(keys)) == keys


def test_front():
    for keys in (["stone", "stork", "story", "stove"], ["x"], ["", "a"], ["é", "éa"]):
        assert unfront(front(keys)) == keys


def test_short_strings():
    keys = ["the cat", "the dog", "a cat and a dog"] * 5
    book = ShortStrings.learned(keys)
    for key in [*keys, "", "QUITE éùÜ other 12345" * 30]:
        assert book.decode(book.encode(key)) == key
    assert len(book.encode("the cat")) < 5
    with pytest.raises(ValueError):
        ShortStrings([b"a", b"a"])


@pytest.mark.parametrize("how", ["plain", "gve", "gve_split", "vbyte", "pfor", "pfor_split"])
def test_postings(how):
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 5, 60, 400):
        locs = sorted((rng.randrange(9), rng.randrange(40), rng.randrange(1 << 30)) for _ in range(n))
        ints = [x for loc in locs for x in loc]
        assert decode_postings(encode_postings(ints, how), how) == ints
    assert decode_postings(encode_postings([0, 0, 0], how), how) == [0, 0, 0]
    with pytest.raises(ValueError):
        encode_postings([1, 2, 3], "nope")
