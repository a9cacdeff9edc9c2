"""The corpus queries against their SQL, and the pipeline against its stages."""

import os

import pytest
from oracle import compare, connect

import corpus_pipeline
from raceframe.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    if name in queries.ORACLES:
        assert compare(df, con, queries.ORACLES[name]) is None
    else:
        # One row per document; the whitening has four components per vector.
        source, times = ("embeddings", 4) if name == "op13_whitening" else ("documents", 1)
        assert df.count() == times * spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()


def test_pipeline_keeps_columns_and_decides(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == documents.columns and docs.count() <= before, name
    assert documents.filter("doc_id >= 0").count() > docs.count() > 0.8 * documents.count()
    mixed = corpus_pipeline.run(spark, SF_DIR)
    assert mixed.count() == docs.count() and mixed.filter("taken > 2 * size").count() == 0
