"""The registered queries against their SQL, and the pipeline's stages on the smallest tables."""

import oracle
import pytest

import corpus_pipeline
from logtide.llm import queries
from logtide.plans.catalog import Entry

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, name):
    _, _, problem = oracle.compare(spark, oracle.connect(folder), name, Entry(queries.queries()[name], SQL[name]), folder)
    assert not problem


def test_pipeline_stages(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.replaced(stage(spark, docs, folder), name)
        assert made.count() <= seen and made.select("doc_id").distinct().count() == made.count()
        if name == "near-dedup":
            assert made.join(docs, "doc_id").count() == made.count()
        if name != "tokens":
            assert made.columns == columns
        docs, seen = made, made.count()
    assert 0 < seen and docs.columns[:2] == ["doc_id", "n_tokens"]


def test_pipeline_of_no_documents(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.replaced(stage(spark, docs, folder), name)
    assert docs.count() == 0
