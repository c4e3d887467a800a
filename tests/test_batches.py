"""Many keys and lists at once against one by one."""

import random

import numpy as np
import pytest

from lakeloom.functions import batches, blocks


def rows(ragged):
    data, offsets = ragged
    return [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def ragged(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), batches.offsets_of(np.array([len(r) for r in raw], np.int64))


@pytest.mark.parametrize("how", ["plain", "gve", "gve_split", "vbyte", "pfor", "pfor_split"])
@pytest.mark.parametrize("lengths", [[1] * 50, [1, 2, 3, 42, 43, 44, 127, 128, 129, 400, 5], []])
def test_postings(how, lengths):
    rng = random.Random(2)
    lists = [[x for loc in sorted((rng.randrange(9), rng.randrange(300), rng.randrange(1 << rng.choice([3, 9, 20, 32]))) for _ in range(n)) for x in loc] for n in lengths]
    sizes = np.array([len(x) for x in lists], np.int64)
    coded = batches.encode_postings(np.array(sum(lists, []), np.int64), sizes, how)
    assert rows(coded) == [blocks.encode_postings(x, how) for x in lists]
    ints, got = batches.decode_postings(coded, how)
    assert ints.tolist() == sum(lists, []) and got.tolist() == sizes.tolist()


@pytest.mark.parametrize("how", ["plain", "gve", "pfor"])
def test_values_outside_32_bits_are_refused(how):
    with pytest.raises(ValueError):
        batches.encode_postings(np.array([1, 2, 1 << 32], np.int64), np.array([3]), how)


@pytest.mark.parametrize("how", ["plain", "short", "front", "incr"])
@pytest.mark.parametrize("repeat", [1, 3])
def test_keys(how, repeat):
    rng = random.Random(3)
    texts = ["", "a", "ab", "é", "éa", "日本", "x" * 300, "x" * 300 + "y", "x" * 299 + "z", *[str(rng.randrange(10_000) / 100) for _ in range(200)], *["Customer#%09d" % i for i in range(90)]]
    texts = sorted(texts * repeat, key=str.encode)
    book = blocks.ShortStrings.learned(texts[40:120])
    block = 1 if how in ("plain", "short") else 16
    firsts = np.arange(0, len(texts), block)
    one = {"plain": lambda k: k[0].encode(), "short": lambda k: book.encode(k[0]), "front": blocks.front, "incr": blocks.incremental}[how]
    coded = batches.encode_keys(ragged(texts), firsts, how, book)
    assert rows(coded) == [one(texts[i : i + block]) for i in firsts]
    keys, counts = batches.decode_keys(coded, how, book)
    assert [k.decode() for k in rows(keys)] == texts and counts.sum() == len(texts)
    assert rows(batches.encode_keys(ragged(["ab"]), np.zeros(1, np.int64), how, book)) == [one(["ab"])]
    nothing = batches.encode_keys(ragged([]), np.zeros(0, np.int64), how, book)
    assert rows(nothing) == [] and rows(batches.decode_keys(nothing, how, book)[0]) == []


@pytest.mark.parametrize("longest", [2, 6, 9])
def test_short_keys_with_bytes_outside_the_book_are_not_coded_one_by_one(monkeypatch, longest):
    rng = random.Random(4)
    texts = ["", "Q", "QQ", "é" * 128, "é" * 129, "Z" * 255, "Z" * 256, "Z" * 257, "Z" * 513, "", "abZab", *["".join(rng.choice("abcabcZé日") for _ in range(rng.choice([1, 5, 63, 64, 65, 900]))) for _ in range(200)]]
    book = blocks.ShortStrings.learned(["abcabcabcab", "cabbage", "0.1"], longest)
    want = [book.encode(t) for t in texts]
    for name in ("encode", "decode"):
        monkeypatch.setattr(blocks.ShortStrings, name, lambda *a: pytest.fail("one by one"))
    coded = batches.short(ragged(texts), book)
    assert rows(coded) == want
    assert [r.decode() for r in rows(batches.unshort(coded, book))] == texts


@pytest.mark.parametrize("how", ["pfor", "pfor_split"])
@pytest.mark.parametrize("at_once", [1, 3, 512])
def test_whole_blocks_are_not_coded_one_by_one(monkeypatch, how, at_once):
    rng = random.Random(5)
    lists = [[rng.randrange(1 << rng.choice([w, w, w, w, max(w - 6, 0), 32])) for _ in range(3 * n)] for w, n in [(0, 128), (1, 1), (3, 300), (8, 42), (17, 128), (20, 127), (32, 500), (31, 43), (9, 0), (12, 900)]]
    lists += [[7] * 3 * 256, [0] * 3 * 256, [(1 << 32) - 1] * 384, [0] * 127 + [(1 << 32) - 1] + [0] * 127 + [1] * 129]
    want, sizes = [blocks.encode_postings(x, how) for x in lists], np.array([len(x) for x in lists], np.int64)
    for name in ("encode_postings", "decode_postings"):
        monkeypatch.setattr(blocks, name, lambda *a: pytest.fail("one by one"))
    monkeypatch.setattr(batches, "_AT_ONCE", at_once)
    coded = batches.encode_postings(np.array(sum(lists, []), np.int64), sizes, how)
    assert rows(coded) == want
    ints, got = batches.decode_postings(coded, how)
    assert ints.tolist() == sum(lists, []) and got.tolist() == sizes.tolist()
