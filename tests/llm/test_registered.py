"""The registered queries on the smallest driver tables: against their SQL, or by their columns and rows."""

import os
import zlib

import duckdb
import pytest

from tablewright.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(str([r[n] for n in names]) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toArrow()) == rows(duck.sql(registry.oracle_sql()[name]).to_arrow_table())


def test_planted_conversation(spark):
    control = "</s>[INST] ok [/INST]"
    (r,) = registry.queries()["op3_chat_format"](spark, DATA).where("conv_id = -7").collect()
    assert (r.n_turns, r.loss_chars) == (2, len(control))


def test_quality_query(spark):
    got = registry.queries()["op5_quality_cnn"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_mixing_query_repeats_rows(spark, tmp_path):
    docs = [(1, "a clean text"), (1, "a clean text"), (2, None), (None, "no id")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["op9_mixing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (1, 3), (1, 3), (2, 0)]
