import corpus_pipeline
import pytest

from .conftest import EDGES


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.saved(stage(spark, docs, folder), "stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert out.select("doc_id").distinct().exceptAll(docs.select("doc_id").distinct()).isEmpty()
        if name in ("toxicity", "near-duplicates", "decontaminate"):
            assert 0.5 * count < out.count() < docs.count()
        docs = out
    assert docs.select("shard").distinct().count() > 20


@pytest.mark.parametrize("number", range(5))
def test_stages_on_edges(spark, tables, number):
    folder = tables(True, documents=EDGES, benchmark=[(1, "zz yy")], labels=[(4, 1, 0), (5, 1, 1)])
    stage = corpus_pipeline.STAGES[number][1]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    assert set(docs.columns) <= set(out.columns) and out.count() > 0
    empty = spark.read.parquet(f"{tables(True)}/documents.parquet")
    assert stage(spark, empty, folder).count() == 0
