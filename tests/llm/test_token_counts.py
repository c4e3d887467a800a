import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lakeloom.llm.token_counts import BLANK, Counting, count_tokens, read_pieces

SCHEMA = "doc_id long, text string, n_tokens string"


def library(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(BLANK, "always", True)
    return t


def counts(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(12))
def test_ties_as_in_the_library(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc" + BLANK) for _ in range(rng.choice([1, 2, 2, 3, 4]))): float(-rng.randrange(1, 5)) for _ in range(25)}
    pieces = [(p, s) for p, s in pieces.items()]
    # the library takes the unknown piece's score into the least one
    t, c = library([(p, s) for p, s in pieces]), Counting(pieces)
    for _ in range(300):
        text = "".join(rng.choice("abcxé  \n" + BLANK) for _ in range(rng.randrange(1, 25)))
        assert c.text(text)[0] == counts(t, text), text


def test_public_vocabulary(spark, sf_dir):
    pieces = read_pieces()
    t = library(pieces)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows)).collect()}
    assert got == {r.doc_id: counts(t, r.text) for r in rows}


def test_edges(spark):
    pieces = [("a", -1.0), (BLANK, -2.0), (BLANK + "a", -2.5), ("aa", -2.0)]
    rows = [(1, None, ""), (2, "", ""), (None, "a", ""), (3, "aaa", ""), (3, "aaa", ""), (4, "xyz", ""), (5, "a" * 100_000, ""), (6, " ", "")]
    got = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in count_tokens(spark.createDataFrame(rows, SCHEMA), pieces).collect())
    assert got[:5] == [(0, 1, -2.5), (1, 0, 0.0), (2, 0, 0.0), (3, 2, -4.5), (3, 2, -4.5)]
    assert (4, 2, -2.0 - 3 * 12.5) in got and (6, 1, -2.0) in got
    assert count_tokens(spark.createDataFrame([], SCHEMA), pieces).collect() == []
    assert Counting([]).text("ab")[0] == 1
