"""The pipeline stage by stage, and the queries against their DuckDB twins."""

import glob
import os

import duckdb
import pytest

from plumbline.llm import queries


def test_stages_keep_the_columns_and_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.saved(stage(spark, before, sf))
        assert after.columns == docs.columns, name
        assert 0.6 * before.count() < after.count() <= before.count(), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.STAGES[1][1](spark, before, sf).count() == before.count()  # nothing near is left


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql())))
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    mine, other = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    rows = [sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False, name=None)) for frame in (mine, other)]
    assert rows[0] == rows[1]
