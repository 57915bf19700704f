"""Component sums are dealt over a number of tasks that grows with the rows, and cost nothing without totals."""

from pyspark.sql import functions as F

from tablewright import session
from tablewright.operators import quality


def _tables(spark, n):
    rows = spark.range(n).select(F.col("id").alias("task_id"), F.lit(0).alias("table_seq"), F.explode(F.array(*[F.struct(F.lit(i).alias("row_seq"), F.lit(x).alias("item"), F.array(*[F.lit(c) for c in cs]).cast("array<string>").alias("components"), F.lit(v).alias("value")) for i, x, cs, v in ((0, "a", (), 1.0), (1, "A", (), 2.0), (2, "b", (), 3.0), (3, "sum", ("a", "B", "ghost"), 5.0), (4, "bad", ("b", "b"), 5.0), (5, "none", ("ghost",), 1.0))])).alias("r")).select("task_id", "table_seq", "r.*")
    cells = rows.select("task_id", "table_seq", "row_seq", F.lit(0).alias("cell_index"), F.lit("p").alias("period"), F.col("value").cast("string").alias("raw"), "value")
    return rows.drop("value"), cells


def test_tasks_grow_with_rows(spark, monkeypatch):
    rows, cells = _tables(spark, 40)
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    checks = quality.component_sums(rows, cells)
    dealt = [x for x in checks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) >= 7 and all(x.endswith(", 12") for x in dealt)
    assert {(r.row, r.status, r["count"]) for r in checks.groupBy("row", "status").count().collect()} == {("sum", "pass", 40), ("bad", "fail", 40), ("none", "warn", 40)}
    assert checks.where("row = 'bad'").first().detail == "p: expected 5.0, got 6.0"


def test_without_totals(spark):
    rows, cells = _tables(spark, 3)
    checks = quality.component_sums(rows.withColumn("components", F.array().cast("array<string>")), cells)
    assert checks.count() == 0 and "Join" not in checks._jdf.queryExecution().optimizedPlan().toString()
