"""Every registered query outside the training-data subpackage against its DuckDB twin."""

import glob
import os

import duckdb
import pytest

from plumbline.plans.oracles import SQL
from plumbline.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, duck, sf_dir, name):
    mine, other = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert _rows(mine, sorted(mine.columns)) == _rows(other, sorted(other.columns))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
