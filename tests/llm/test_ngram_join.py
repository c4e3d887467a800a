import random
import re

import pytest

from lakeloom.llm.components import components
from lakeloom.llm.ngram_join import _apart, _group_links, keep_one, ngram_join

SCHEMA = "doc_id long, text string, extra string"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _, _) in enumerate(rows))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [a + b for a in "bcdfg" for b in ("a", "e", "io")] + ["The", "É", "x y"]
    rows, texts = [], []
    line = " ".join(rng.choice(words) for _ in range(12))
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 and texts:
            base = rng.choice(texts[: 1 + len(texts) // 4]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        elif kind < 0.7:
            text = line + " " + " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30])))
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200])))
        texts.append(text)
        rows.append((i, text, "x"))
    return rows + [(n, "", "x"), (n + 1, None, "x"), (n + 2, " \t\n", "x"), (n + 3, "THE the", "x"), (n + 4, "the The", "x"), (0, rows[0][1], "y")]


@pytest.mark.parametrize(("k", "num", "den", "heavy", "hubs"), [(3, 9, 10, 4, 1), (5, 4, 5, 32, 2), (2, 1, 2, 2, 0)])
def test_against_brute_force(spark, k, num, den, heavy, hubs):
    rows = corpus(k)
    got = ngram_join(spark.createDataFrame(rows, SCHEMA), k, num, den, heavy, hubs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, num, den)


def test_edges_and_empty(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (None, None, "x")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (None, 0, None)}


def test_keep_one(spark):
    rows = corpus(9, 60)
    kept = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "extra"]
    want = {c for d, n, c in brute(rows, 5, 4, 5) if n} | {60, 61, 62}
    assert {r.doc_id for r in kept.collect()} == want


def test_keep_one_with_repeated_and_null_ids(spark):
    text = lambda *words: " ".join(f"{w}{i}" for w in words for i in range(12))
    rows = [(3, text("a"), "x"), (7, text("a"), "y"), (7, text("b"), "y"), (7, text("b").upper(), "z"), (None, text("c"), "x"), (None, text("c"), "w"), (None, text("d"), "x"), (None, text("b"), "n"), (None, "", "x"), (7, None, "x"), (5, text("e"), "x")]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(3, text("a"), "x"), (7, text("b").upper(), "z"), (None, text("c"), None), (None, text("d"), "x"), (None, "", "x"), (7, None, "x"), (5, text("e"), "x")]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((d or 0, t or "") for d, t, _ in want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (2, 1), (20, 19), (19, 18), (18, 17), (17, 16), (16, 20)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16}


def near_copies(seed, n, length=60, most=9):
    """Copies of one text with up to `most` words replaced, some by words that other copies have too."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    part = [f"p{i}" for i in range(8)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(most)):
            words[rng.randrange(length)] = rng.choice(["x", "y", f"own{rng.random()}"])
        if rng.random() < 0.2:
            words[10:18] = part
        rows.append((i, " ".join(words), "x"))
    return rows


@pytest.mark.parametrize(("k", "num", "den", "group"), [(3, 9, 10, 32), (5, 4, 5, 4), (1, 9, 10, 8)])
def test_dense_group(spark, monkeypatch, k, num, den, group):
    monkeypatch.setattr("lakeloom.llm.ngram_join.GROUP", group)
    monkeypatch.setattr("lakeloom.llm.ngram_join.DEALT", 10)
    rows = near_copies(k, 160) + [(d + 1000, t.upper(), x) for d, t, x in near_copies(k, 12)]
    got = ngram_join(spark.createDataFrame(rows, SCHEMA), k, num, den, 8).collect()
    want = brute(rows, k, num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 1 < len({c for _, _, c in want}) < len(rows)


def test_group_links(spark):
    """Inside a group every link between components is found from the differences, and nothing else."""
    rows = near_copies(5, 90)
    sets = {d: shingles(t, 2) for d, t, _ in rows}
    held = {t for s in sets.values() for t in s}
    number = {t: i for i, t in enumerate(sorted(held))}
    count = {t: sum(t in s for s in sets.values()) for t in held}
    wide = [(d, len(s), number[t], count[t], 0, sum(count[x] == 1 for x in s)) for d, s in sets.items() for t in s if count[t] > 1]
    frame = spark.createDataFrame(wide, "cid long, n long, t long, c long, rank long, lone long")
    groups = spark.createDataFrame([(d, 1, len(sets)) for d in sets], "cid long, g long, members long")
    apart = _apart(frame, groups, 4, 5)
    assert apart.count() == len(sets)
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in _group_links(apart, 4, 5).collect()}
    real = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert links <= real
    assert len(links) < len(real) / 4
    merged = dict(components(spark.createDataFrame(sorted(links), "a long, b long")).collect())
    assert all(merged[a] == merged[b] for a, b in real)
