"""The corpus pipeline, stage by stage on its own input."""

import corpus_pipeline
from tests.conftest import SF


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.count()
        assert 0 < rows <= n
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns and out.schema == docs.schema
        docs, n = out.cache(), rows
    assert {"ids", "decoded"} <= set(docs.columns)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_gives_the_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert "n_tokens" in rows.columns and rows.count() > 0
