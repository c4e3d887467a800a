import numpy as np
import pytest

from lakeloom.functions.codecs import CODECS, VS_HEAD, VS_RUNS, VS_WIDTHS, VS_ZERO_RUNS, bits, codec, fastpfor_width, newpfor_width, optpfor_width, pack, pfor_width, unpack, vs_partition

NARROW = {"simple9", "simple16"}


def grid():
    for b in range(0, 28, 3):
        for n in (0, 1, 5, 127, 128, 256, 300):
            i = np.arange(n, dtype=np.int64)
            yield ((i + (24 - i) * (12 - i)) % (1 << b)).astype(np.int64)
            yield ((33231 - i + i * i) % (1 << b)).astype(np.int64)
    yield np.arange(0, 256, 2)
    yield np.arange(0, 1000, 3)
    yield np.zeros(700, np.int64)
    planted = np.zeros(512, np.int64)
    planted[[3, 200, 201, 400]] = 1 << 27
    yield planted
    yield np.where(np.arange(3000) % 150 == 0, np.arange(3000), 0)
    yield np.arange(1024) * 438248 % 732819 + 7


@pytest.mark.parametrize("name", CODECS)
def test_round_trip(name):
    c = codec(name)
    for v in grid():
        words = c.encode(v)
        assert words.dtype == np.uint32
        back, used = c.decode(words, len(v))
        assert (back == v).all() and used <= len(words)


@pytest.mark.parametrize("name", [n for n in CODECS if n not in NARROW | {"simple9_rle"}])
def test_all_32_bits(name):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 32, 400)
    v[::7] = rng.integers(0, 4, len(v[::7]))
    v[5], v[300] = 0, (1 << 32) - 1
    assert (codec(name).decode(codec(name).encode(v), 400)[0] == v).all()


def test_count_and_unknown():
    assert len(CODECS) >= 32
    with pytest.raises(ValueError):
        codec("vsenconding")
    for name in NARROW:
        with pytest.raises(ValueError):
            codec(name).encode(np.array([1 << 28]))


@pytest.mark.parametrize("b", range(33))
def test_packing(b):
    v = np.random.default_rng(b).integers(0, 1 << b, 77) if b else np.zeros(77, np.int64)
    assert (unpack(pack(v, b), b, 77) == v).all()
    assert (bits(v) <= b).all()


def test_widths():
    v = np.zeros(128, np.int64)
    v[3] = 1 << 20
    assert fastpfor_width(v, True) == 0 and newpfor_width(v) == 0
    assert pfor_width(np.full(128, 5)) == 3
    assert optpfor_width(v) in (0, 1)


@pytest.mark.parametrize("seed", range(8))
def test_vs_partition_is_optimal(seed):
    n = 11
    w = (np.random.default_rng(seed).integers(0, 15, n) * (np.random.default_rng(seed + 99).random(n) < 0.4 + seed / 15)).tolist()

    def size(part):
        """Bits of a run, none if there is no such run."""
        top = next(b for b in VS_WIDTHS if b >= max(part))
        return VS_HEAD + len(part) * top if len(part) in (VS_RUNS if top else VS_ZERO_RUNS) else None

    def least(at):
        return 0 if at == n else min(s + least(at + k) for k in range(1, n - at + 1) if (s := size(w[at : at + k])) is not None)

    runs, at, bits_ = vs_partition(w), 0, 0
    for length, b in runs:
        assert max(w[at : at + length]) <= b
        bits_ += VS_HEAD + length * b
        at += length
    assert at == n and bits_ == least(0)


def test_vs_runs_of_zeros():
    assert [x for x, _ in vs_partition([0] * 64)] == [32, 32]
    assert 15 not in [x for x, _ in vs_partition([0] * 15)]


@pytest.mark.parametrize("n", [0, 4, 32, 400])
def test_ring_buffer_keeps_a_gap(n):
    v = np.arange(n) % 2
    tight, wide = (codec(c).encode(v) for c in ("simdgroupsimple", "simdgroupsimple_ringbuf"))
    used = -(-len(range(0, n // 4, 32)) * 4 // 32)
    assert len(wide) - len(tight) == -(-n // 4 * 4 // 32) - used
