"""Stores around the engine: tasks, plans, traces, results, task maps, and grids of other table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, parse_number
from .artifacts import append_trace, latest_tasks, write_results

# Fixed values.
RESULT, TRACE = "/result.json", "/trace.jsonl"
# End of fixed values.


def save_tasks(records: DataFrame, path: str) -> None:
    """Append versions of task records (task_id, updated_at, ...); :func:`load_tasks` keeps the last of each."""
    records.write.mode("append").parquet(path)


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    return latest_tasks(spark.read.parquet(path))


def save_plans(plan: DataFrame, levels: DataFrame, path: str) -> None:
    """One JSON line for each task: its steps in order with their levels."""
    rows = plan.join(levels, ["task_id", "name"], "left")
    step = F.struct("step_seq", "name", "tool", "depends_on", "level")
    rows.groupBy("task_id").agg(F.sort_array(F.collect_list(step)).alias("steps")).write.mode("overwrite").json(path)


def save_run(run, path: str) -> None:
    """Plans, trace and results of a :class:`..plans.driver.Run` under ``path``."""
    save_plans(run.plan, run.levels, f"{path}/plans")
    append_trace(run.trace, f"{path}/trace")
    write_results(run.results, f"{path}/results")


def prefer_rows(*sources: DataFrame, key: str = "task_id") -> DataFrame:
    """Of each key the rows of the first source that has it: saved results with places to fall back to."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def task_map(files: DataFrame) -> DataFrame:
    """task_name, task_id of task maps (json: an object of ids, or of objects with a task_id). Other shapes are left out."""
    pairs = files.sparkSession.sql("SELECT p.key AS task_name, p.value AS v FROM (SELECT try_parse_json(json) AS v FROM {f}) f, LATERAL variant_explode(f.v) p", f=files.select("json"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string"))
    return pairs.where("task_name is not null").select("task_name", F.coalesce(text("$"), text("$.task_id")).alias("task_id")).where("task_id is not null")


def local_status(files: DataFrame) -> DataFrame:
    """task_id, status from files (path, json): the result's status, ``running`` if there is only a trace; null if the result can't be read."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    of = files.select(folder.alias("task_id"), F.endswith("path", F.lit(RESULT)).alias("result"), F.endswith("path", F.lit(TRACE)).alias("trace"), F.get_json_object("json", "$.status").alias("status")).where("result or trace")
    g = of.groupBy("task_id").agg(F.bool_or("result").alias("result"), F.max(F.when(F.col("result"), F.col("status"))).alias("status"))
    return g.select("task_id", F.when(F.col("result"), F.col("status")).otherwise("running").alias("status"))


def map_summary(mapped: DataFrame, results: DataFrame, status: DataFrame) -> DataFrame:
    """A line for each mapped task, also without a result: status and what its result says of quality."""
    told = ["summary", "table_count", "failed_count", "warning_count", "numeric_parse_coverage", "evidence_coverage", "financial_table_count"]
    return mapped.join(status, "task_id", "left").join(results.select("task_id", *told), "task_id", "left").select("task_name", "task_id", "status", *told)


def grid_tables(grids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, rows and cells of plain grids (task_id, page, table_index, grid): the first row that isn't blank is the header.

    Blank headers are ``col_i`` from 1, blank labels ``row_i`` from 0; grids of fewer than two rows, and
    those without a row of two columns, are dropped.
    """
    key = ["task_id", "page", "table_index"]
    clean = F.filter(F.transform("grid", lambda row: F.transform(row, normalize_text)), lambda row: F.exists(row, lambda x: x != ""))
    held = grids.select(*key, clean.alias("grid")).where("size(grid) >= 2")
    head = F.slice(F.get("grid", F.lit(0)), 2, 1 << 20)
    held = held.withColumn("periods", F.transform(head, lambda x, i: F.when(x == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(x)))
    lines = held.select(*key, "periods", F.posexplode(F.slice("grid", 2, 1 << 20)).alias("at", "line")).where("size(line) >= 2")
    order = Window.partitionBy(*key).orderBy("at")
    lines = lines.withColumn("row_seq", F.row_number().over(order) - 1)
    item: Column = F.get("line", F.lit(0))
    rows = lines.select(*key, "row_seq", F.when(item == "", F.concat(F.lit("row_"), F.col("at").cast("string"))).otherwise(item).alias("item"), F.col("page").alias("row_page"))
    each = lines.select(*key, "row_seq", "periods", F.posexplode(F.slice("line", 2, 1 << 20)).alias("cell_index", "raw"))
    period = F.coalesce(F.get("periods", F.col("cell_index")), F.concat(F.lit("col_"), F.col("cell_index").cast("string")))
    cells = each.select(*key, "row_seq", "cell_index", period.alias("period"), "raw", parse_number("raw").alias("value"))
    tables = held.join(rows.select(*key).distinct(), key, "left_semi").select(*key, F.format_string("grid_table_p%d_%d", "page", "table_index").alias("name"), "periods", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return tables, rows, cells
