"""The pipeline at the smallest scale: each stage's contract, and its decisions by brute force."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.shingles import shingle_set, similar

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= before and len(now) > 0.7 * len(before)
        before = now
        if name == "near_dedup":
            sets = [shingle_set(r["text"], 5) for r in docs.select("text").collect()]
            assert not any(similar(a, b, 80, 100) for i, a in enumerate(sets) for b in sets[:i])
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in mix.collect():
        assert set(r["doc_ids"]) <= set(texts) and len(r["text"].split()) == r["n_words"]
        if len(r["doc_ids"]) == 1:
            assert r["text"] in " ".join(texts[r["doc_ids"][0]])


def test_stages_on_odd_rows(spark):
    """Nulls in any column, blank and repeated rows, further columns, an empty table."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "a"), (1, text, "a"), (2, None, None), (3, "", "a"), (4, "  ", None), (None, text + " x", "b"), (None, None, None), (5, text.upper() + " y z", None), (6, " ".join(f"other{i}" for i in range(90)), "b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, id int, source_size string")
    for stage_rows in (docs, docs.limit(0)):
        now = stage_rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.cut(stage(spark, now, SF), name)
            assert now.columns == docs.columns
        mixed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert bool(mixed) == (now.count() > 0)
    kept = sorted(str(r["doc_id"]) for r in now.collect())
    assert kept == []  # of the empty table
