from collections import Counter

import corpus_pipeline
from lakeloom.llm.packing import boundaries
from tests.llm.test_decontamination import made as leaks
from tests.llm.test_ngram_join import brute


def test_stages_on_planted_documents(spark, tmp_path):
    docs, items, leaked = leaks()
    rows = [(d, t, "en", "s", len(t or "")) for d, t, _, _ in docs if d is not None]
    rows += [(None, items[5][1], "en", "s", 1), (None, "a row that has no number and stays", "en", "s", 1)]
    base = " ".join(f"word{i}" for i in range(60))
    rows += [(2000, base, "en", "s", 1), (2001, base, "en", "s", 1), (2002, base + " more", "en", "s", 1), (2001, base, "en", "s", 1)]
    rows += [(3000 + i, f"number {i} is a vile grolm " + " ".join(f"t{i}x{j}" for j in range(30)), "en", "s", 1) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(3000 + i, 1, 1) for i in range(30)] + [(d, 1, 0) for d in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, t) for i, t, _ in items], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "packing"]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.n_tokens for r in got if r.doc_id is None] == [8]
    got = [r for r in got if r.doc_id is not None]
    clean = [(d, t, "") for d, t, *_ in rows if d is not None and d < 3000]
    component = {d: c for d, n, c in brute(clean, 5, 4, 5) if n}
    want = {d for d, _, _ in clean if component.get(d, d) == d} - {d for d, _ in leaked}
    assert {r.doc_id for r in got} == want
    assert len(got) == len(want)
    text = {d: t or "" for d, t, _ in clean}
    bounds = boundaries(list(Counter([8, *(len(text[d].split()) for d in want)]).items()), 16)
    assert all(r.n_tokens == len(text[r.doc_id].split()) and r.bucket_length == bounds[r.bucket] for r in got)


def test_stages_return_the_tables_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_empty(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
