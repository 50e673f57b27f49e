"""The pipeline's stages on a small corpus with planted cases."""

import os

import pytest

import corpus_pipeline
from lacuna.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("length(text) <> n_chars").isEmpty()
    assert docs.where("text RLIKE '[A-Za-z0-9]+@[a-z0-9]+[.][a-z]+'").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and last.where("n_tokens <> size(ids)").isEmpty()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_names(spark):
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert not differences(spark, connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)
