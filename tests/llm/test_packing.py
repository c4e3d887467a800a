import itertools
import random
from collections import Counter, defaultdict

import pytest

from lakeloom.llm.packing import boundaries, pack

SCHEMA = "doc_id long, text string, n_tokens string, bucket string"


def padding(histogram, bounds):
    return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in histogram)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    histogram = [(n, rng.randrange(1, 30)) for n in rng.sample(range(60), rng.choice([1, 2, 5, 11]))]
    for k in (1, 2, 3, 5):
        bounds = boundaries(histogram, k)
        lengths = sorted(n for n, _ in histogram)
        best = min(padding(histogram, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert len(bounds) == min(k, len(lengths)) and padding(histogram, bounds) == best


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.expovariate(0.02))), "x", "y") for i in range(400)] + [(None, None, None, None), (3, "", "", ""), (3, "\t a\nb ", "", ""), (9, "long " * 5000, "", "")]
    got = pack(spark.createDataFrame(rows, SCHEMA), 5, 1000).collect()
    want = Counter((d, len((t or "").split())) for d, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    bounds = boundaries(list(Counter(n for _, n in want.elements()).items()), 5)
    batches = defaultdict(list)
    for r in got:
        assert r.bucket_length == bounds[r.bucket] and r.n_tokens <= r.bucket_length and (not r.bucket or r.n_tokens > bounds[r.bucket - 1])
        batches[r.batch_id].append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = Counter()
    for held in batches.values():
        fit = max(1, 1000 // held[0].bucket_length)
        assert len({r.bucket for r in held}) == 1 and len(held) <= fit
        assert sorted(r.position for r in held) == list(range(len(held)))
        short[held[0].bucket] += len(held) < fit
    assert max(short.values()) <= 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
