"""Every catalogue query against its SQL on the smallest driver tables."""

import os

import duckdb
import pyarrow as pa
import pytest

from tablewright import queries as catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table: pa.Table):
    names = sorted(table.column_names)
    return sorted(str([r[n] for n in names]) for r in table.select(names).to_pylist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toArrow(), duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
