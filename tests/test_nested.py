"""Tables stored once with their lines: what is unfolded from them, and how often the blocks are read."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import evaluate, references, structure

TABLES = [
    {"title": "A", "unit": "USD", "periods": ["p", "q", "p"], "table_footnote": ["see", {"text": "note"}], "rows": [{"label": " x ", "values": ["1", "USD 2", "(3)"]}, 5, None, {"item": "y", "cells": ["n/k"], "page_idx": 7}, {"label": "X", "values": ["4", "5"], "components": ["x "]}]},
    {"title": "B", "table_footnote": " plain  note", "table_rows": {"b": {"name": "n", "data": ["8"]}, "a": 3}},
    {"title": "C"},
]
HTML = {"title": "D", "html": "<table><tr><th>i</th><th>u</th></tr><tr><td>z</td><td>9</td></tr></table>"}


def tables(spark, contents):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, json.dumps(c)) for i, c in enumerate(contents)], 1).map(lambda r: (seen.add(1), r)[1])
    d = spark.createDataFrame(rows, "task_id long, json string")
    absent = F.lit(None).cast("string")
    blocks = d.select("task_id", F.lit(0).cast("long").alias("block_seq"), F.lit(2).alias("page_idx"), F.lit("table").alias("block_type"), absent.alias("bbox"), F.parse_json("json").alias("content"), absent.alias("title"), absent.alias("text"), absent.alias("context_title"), absent.alias("context_unit"))
    return structure.normalize_tables(structure.classify(blocks)), seen


@pytest.mark.parametrize("html", [False, True])
def test_blocks_are_read_once(spark, html):
    t, seen = tables(spark, TABLES + [HTML] * html)
    heads = {r.task_id: r for r in t.tables.collect()}
    rows = sorted((r.task_id, r.row_seq, r.item, r.page, r.components) for r in t.rows.collect())
    cells = sorted((r.task_id, r.row_seq, r.cell_index, r.period, r.value) for r in t.cells.collect())
    drawn = [(3, 0, "z", 2, [])] if html else []
    assert rows == [(0, 0, "x", 2, []), (0, 3, "y", 7, []), (0, 4, "X", 2, ["x"]), (1, 1, "n", 2, []), *drawn]
    assert cells == [(0, 0, 0, "p", 1), (0, 0, 1, "q", 2), (0, 0, 2, "p", -3), (0, 3, 0, "0", None), (0, 4, 0, "0", 4), (0, 4, 1, "1", 5), (1, 1, 0, "0", 8), *([(3, 0, 0, "u", 9)] if html else [])]
    assert [heads[i].footnote for i in range(3)] == ["see note", "plain note", ""] and (not html or heads[3].periods == ["u"])
    found = sorted((r.task_id, r.label, r.period, r.value) for r in references.metric_candidates(t).collect())
    assert found == sorted([(0, "x", "q", 2), (0, "x", "p", -3), (0, "X", "0", 4), (0, "X", "1", 5), (1, "n", "0", 8), *([(3, "z", "u", 9)] if html else [])])
    assert seen.value == len(TABLES) + html


def test_nested_of_joined_tables(spark):
    """Tables that aren't stored with their lines are evaluated alike; the last of equal labels counts, a null token is in no label."""
    t, _ = tables(spark, TABLES)
    cases = t.tables.select(F.col("task_id").alias("case_id"), "task_id", F.lower("title").alias("expected_table"), F.lit("").alias("expected_warning_type"))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = (cases, one([(0, "x", "0", 4.0), (0, "x", "p", 1.0)], "case_id long, row string, period string, value double"), one([(0, "Q")], "case_id long, label string"), one([(0, "Y"), (0, None), (2, "y")], "case_id long, token string"), one([], "case_id long, flag string, expected string"), one([], "task_id long, type string"), one([], "task_id long, flag string, value string"))
    results = [sorted((r.case_id, r["name"], str(r.what), r.status) for r in evaluate.edge_checks(x, *args).collect()) for x in (t, structure.Tables(t.tables, t.rows, t.cells))]
    assert results[0] == results[1]
    assert [r for r in results[0] if r[1] in ("required_metric", "forbidden_row")] == [(0, "forbidden_row", "None", "pass"), (0, "forbidden_row", "Y", "fail"), (0, "required_metric", "x", "fail"), (0, "required_metric", "x", "pass"), (2, "forbidden_row", "y", "pass")]


def test_quick_numbers(spark):
    """Cells that need no cleaning are read as the others are."""
    texts = ["12", "1.50", "USD 7", "RMB8.5", "USD  9", "usd 1", "007", "12\n", "USD", "1.", " 3", "CNY 4\n", None, "5 USD"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    same = df.where(~T.parse_number("x").eqNullSafe(T.parse_number(F.col("x"))) | (T.looks_numeric("x") != T.looks_numeric(F.col("x"))))
    assert same.count() == 0 and df.where(T.parse_number("x").isNull()).count() == 3


def test_units_by_one_pattern(spark):
    """Only units that the context names are cut, by a pattern that is the same for every row."""
    rows = [("5万元", "元", "5万"), ("5 USD million", "usd", "5 million"), ("usdx 5 Usd", "USD", "usdx 5"), ("5百万元", "人民币百万元 百万元", "5"), ("5", "none", None), ("USD", "USD", None), ("5\x02usd", "USD", "5\x02")]
    df = spark.createDataFrame(rows, "x string, u string, want string").withColumn("got", T.strip_context_unit("x", "u"))
    assert [r.got for r in df.collect()] == [w for _, _, w in rows]
    assert "(?siU)" in df._jdf.queryExecution().optimizedPlan().toString()
