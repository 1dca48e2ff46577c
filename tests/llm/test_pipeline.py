"""The pipeline's stages on a small corpus: what each lets through, and the columns."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        if name == "quality":
            gone = [labels[i] for i in before - after if i in labels]
            assert sum(gone) <= 0.2 * len(gone) + 1
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in out.collect()} == before
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_are_registered():
    from quantspan.llm import queries

    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 11))


def test_long_lines_go_in_the_pipeline(spark):
    long = " ".join(f"word{k}" for k in range(corpus_pipeline.LEAST_WORDS))
    rows = [(1, long), (2, long), (3, f"own\n{long}"), (4, "short"), (5, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.line_runs(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, long), (3, "own"), (4, "short"), (5, "short")]
