import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lakeloom.llm.sharding import lpt, plan_table, shard

SCHEMA = "doc_id long, text string, size string, shard string"


def loads(classes, shards):
    heap = [(0, s) for s in range(shards)]
    for size, count in sorted(classes, reverse=True):
        for _ in range(count):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
    return sorted(x for x, _ in heap)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_heap(seed):
    rng = random.Random(seed)
    classes = [(size, rng.choice([1, 2, 7, 500, 3000])) for size in rng.sample(range(1, 5000), 30)] + [(200_000, 1), (90_000, 2)]
    shards = rng.choice([1, 3, 5])
    got, seen = Counter(), {}
    for size, counts in lpt(classes, shards):
        assert size not in seen and len(counts) == shards and min(counts) >= 0
        seen[size] = sum(counts)
        for s, count in enumerate(counts):
            got[s] += size * count
    assert seen == dict(classes)
    assert sorted(got[s] for s in range(shards)) == loads(classes, shards)


def test_rows(spark):
    rng = random.Random(5)
    texts = ["", None, "é" * 7, "x" * 50_000, "same"] + ["w" * rng.randrange(400) + str(i) for i in range(300)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts + ["same"] * 200 + texts[:50])] + [(None, "same", None, None), (3, "x" * 50_000, "", "")]
    got = shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(got) == len(rows)
    text_of = dict((d, t or "") for d, t, _, _ in rows)
    at, total, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        text = text_of[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        at[text].add(r.shard)
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in at.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter(Counter(len((t or "").encode()) + 1 for t in []))
    sizes = Counter()
    for _, t, _, _ in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    groups = Counter(sizes.values())
    assert sorted(total.values()) == loads(list(groups.items()), 4)


def test_plan_is_small():
    table = plan_table([(size, 20) for size in range(1, 20_001)], 16)
    assert table.num_rows == 20_000 and table.nbytes < 20_000 * 150
    for size, upto in zip(*[c.to_pylist() for c in table.columns], strict=True):
        assert len(upto) == 16 and upto == sorted(upto) and upto[-1] == 20 and size > 0


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []
