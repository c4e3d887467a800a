import random

import numpy as np
import pytest

from lakeloom.llm.decontamination import GAP, MATCH, MISMATCH, align, find_copies, without_copies

DOCS = "doc_id long, text string, item_id string, score string"
ITEMS = "item_id long, text string, doc_id string"


def brute(item, words):
    h = np.zeros((len(item) + 1, len(words) + 1), int)
    for i in range(len(item)):
        for j in range(len(words)):
            h[i + 1, j + 1] = max(0, h[i, j] + (MATCH if item[i] == words[j] else MISMATCH), h[i, j + 1] + GAP, h[i + 1, j] + GAP)
    return int(h.max())


@pytest.mark.parametrize("seed", range(20))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    item, words = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
    score, first, last = align(item, words)
    assert score == brute(item, words)
    if score:
        assert brute(item, words[first : last + 1]) == score


def made(seed=4):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 4, 6])))
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 30])))) for i in range(12)] + [(12, None), (13, ""), (14, "Zebra quagga"), (15, "... !"), (0, "twice named item " + " ".join(word() for _ in range(9)))]
    docs, want = [], set()
    for d in range(150):
        words = [word() for _ in range(rng.choice([0, 5, 60, 400]))]
        if rng.random() < 0.3:
            i = rng.randrange(12)
            held = items[i][1].split()
            for _ in range(rng.choice([0, 0, len(held) // 10])):
                held[rng.randrange(len(held))] = "changed"
            words = [*words, *[w.upper() + "," for w in held], *[word() for _ in range(20)]]
            want.add((d, i))
        docs.append((d, " ".join(words), "x", "y"))
    docs += [(500 + i, "before it " + items[3][1] + " after", "x", "y") for i in range(90)] + [(900, "a zebra quagga b", "", ""), (901, None, "", ""), (902, "", "", ""), (903, "zebra x quagga", "", ""), (None, items[5][1], "", "")]
    want |= {(500 + i, 3) for i in range(90)} | {(900, 14), (None, 5)}
    return docs, [(i, t, "clash") for i, t in items], want


def test_planted_copies(spark, monkeypatch):
    docs, items, want = made()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = find_copies(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all("zebra quagga" == r.passage for r in got if r.doc_id == 900)
    monkeypatch.setattr("lakeloom.llm.decontamination.BLOCK", 100)
    assert {(r.doc_id, r.item_id) for r in find_copies(d, b).collect()} == want
    left = without_copies(d, b)
    assert left.columns == ["doc_id", "text", "item_id", "score"]
    assert {r.doc_id for r in left.collect()} == {r[0] for r in docs} - {x for x, _ in want}


def test_empty_tables(spark):
    docs, items, _ = made()
    none_d, none_b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert find_copies(none_d, spark.createDataFrame(items, ITEMS)).collect() == []
    assert find_copies(spark.createDataFrame(docs, DOCS), none_b).collect() == []


@pytest.mark.parametrize("exact", [0, 1, 30])
def test_identically_edited_copies(spark, exact):
    item = [f"word{i}" for i in range(40)]
    edited = [f"new{i}" if i in (5, 15, 25, 35) else w for i, w in enumerate(item)]
    texts = [f"before {' '.join(edited)} after"] * 1000 + [" ".join(item)] * exact + ["nothing of it", " ".join(["word1 word2 word3"] * 5)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.score for r in find_copies(docs, spark.createDataFrame([(0, " ".join(item), "")], ITEMS)).collect()}
    assert got == {i: 0.85 if i < 1000 else 1.0 for i in range(1000 + exact)}


def test_rows_are_judged_one_by_one(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item, "", ""), (None, "clean", "", ""), (7, item, "", ""), (7, "clean too", "", ""), (8, None, "", "")], DOCS)
    items = spark.createDataFrame([(0, item, "")], ITEMS)
    assert {(r.doc_id, r.text) for r in without_copies(docs, items).collect()} == {(None, "clean"), (7, "clean too"), (8, None)}
    assert without_copies(docs, items.where("false")).count() == 5
    assert without_copies(docs.where("false"), items).count() == 0


@pytest.mark.parametrize("copies", [1, 4, 5, 50])
def test_against_brute_force(spark, copies):
    """Every item aligned with every document, the whole of it; copies of items with a tenth of the words edited in all the ways."""
    rng = random.Random(copies)
    words = [f"v{i}" for i in range(60)]
    items = [[rng.choice(words) + rng.choice("ab") for _ in range(rng.choice([10, 20, 35]))] for _ in range(6)]
    texts = [[rng.choice(words) + rng.choice("abc") for _ in range(rng.choice([0, 20, 90]))] for _ in range(40)]
    for item in items[:4]:
        edited = list(item)
        for _ in range(1 + len(item) // 10):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([["other"], [], [edited[at], "more"]])
        for _ in range(copies):
            before = [rng.choice(words) for _ in range(rng.randrange(30))]
            texts.append([*before, *edited, *before[:5]])
    docs = spark.createDataFrame([(d, " ".join(t), "", "") for d, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(t), "") for i, t in enumerate(items)], ITEMS)
    number = {w: i for i, w in enumerate(sorted({w for t in texts + items for w in t}))}
    coded = lambda t: np.array([number[w] for w in t], np.uint64)
    scores = {(d, i): align(coded(item), coded(t))[0] / (MATCH * len(item)) for d, t in enumerate(texts) for i, item in enumerate(items) if t}
    want = {key: score for key, score in scores.items() if score >= 0.5}
    got = {(r.doc_id, r.item_id): r.score for r in find_copies(docs, bench).collect()}
    assert got == want
    assert len(want) >= 4 * copies
