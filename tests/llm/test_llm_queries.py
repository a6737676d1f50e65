"""The registered document queries: against SQL where there is some, and the pipeline's stages."""

import pytest

from dialtrace.llm.registry import ORACLE, QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def tables(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, tables, name):
    assert difference(QUERIES[name](spark, sf_dir), tables, ORACLE[name]) is None


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        assert 0.5 * before < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("length > 1024").isEmpty()
