"""The pipeline's stages against what each should leave."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near_copies import kept_by_force

from grainwise.llm import decontamination, mixing, quality_classifier, token_output


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    scored = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(docs, labels).collect()}
    a = stages[0](spark, docs, sf_dir)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == {i for i, p in scored.items() if p}
    b = stages[1](spark, a, sf_dir)
    # The stage links five-word similarities of 0.8 or more, not fingerprints: one of each group of these is left.
    assert b.columns == docs.columns and sorted(r["doc_id"] for r in b.collect()) == kept_by_force([(r["doc_id"], r["text"]) for r in a.collect()])
    c = stages[2](spark, b, sf_dir)
    leaked = {r["doc_id"] for r in decontamination.overlaps(b, bench).collect()}
    assert {r["doc_id"] for r in c.collect()} == {r["doc_id"] for r in b.collect()} - leaked
    m = stages[3](spark, c, sf_dir)
    assert m.columns == docs.columns and m.count() == mixing.mix_sources(c).selectExpr("sum(copies)").first()[0]
    e = stages[4](spark, m, sf_dir)
    assert e.count() == m.count() and e.columns == token_output.token_output(m).columns


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


NAMES = ("label", "quality", "_k", "_kept", "k", "row", "copies", "_mix_p", "_mix_times", "_leaked", "leaked", "row_key", "quality_score", "fp", "s", "a.b", "occurrence", "place", "raw", "item")


@pytest.mark.parametrize("n", range(5))
def test_odd_rows_in_each_stage(spark, odd, none, sf_dir, n):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, and columns of clashing names."""
    docs = odd.select("doc_id", "text", "lang", "source", *[F.lit(i).alias(x) for i, x in enumerate(NAMES)])
    stage = corpus_pipeline.STAGES[n][1]
    found = stage(spark, docs, sf_dir)
    rows = found.collect()
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if n == 4:
        assert len(rows) == docs.count() and sum(r["n_tokens"] for r in rows) >= len(rows)
        return
    assert found.columns == docs.columns and {tuple(r)[4:] for r in rows} <= {tuple(range(len(NAMES)))}
    there = {(r["doc_id"], r["text"], r["source"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"], r["source"]) for r in rows} <= there
    if n == 1:  # copies, wholly equal rows and texts without words leave one each
        assert len(rows) == len({r["text"] for r in rows}) and sum(not (r["text"] or "").strip() for r in rows) == 1
    if n == 2:
        assert len(rows) == docs.count()
    if n == 3:
        assert len(rows) == sum(r["copies"] for r in mixing.mix_sources(docs).collect())
