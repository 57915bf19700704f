"""Shared context of a task's files and reconciliation of metrics between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

# Fixed values.
SHOWN, SHOWN_RECORDS, SHOWN_CONFLICTS = 20, 5, 20
ABSOLUTE, RELATIVE = 1.0, 0.01
# End of fixed values.


def role_counts(blocks: DataFrame) -> DataFrame:
    """task_id, role, n of blocks; ``unknown`` without a role."""
    return blocks.groupBy("task_id", F.coalesce(F.nullif(normalize_text("role"), F.lit("")), F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))


def shared_context(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """task_id, units, periods, metric_alias_count, metric_alias_examples: distinct texts, the first twenty of each in order."""
    units = tables.select("task_id", F.lit("unit").alias("k"), normalize_text("unit").alias("v"))
    periods = tables.select("task_id", F.explode("periods").alias("p")).union(cells.select("task_id", "period")).select("task_id", F.lit("period").alias("k"), normalize_text("p").alias("v"))
    labels = rows.select("task_id", F.lit("label").alias("k"), F.lower(normalize_text("item")).alias("v"))
    every = units.union(periods).union(labels).where("v <> ''").distinct()
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("task_id", "k").orderBy("v")))
    first = lambda k: F.array_sort(F.collect_list(F.when((F.col("k") == k) & (F.col("rank") <= SHOWN), F.col("v"))))
    return ranked.groupBy("task_id").agg(first("unit").alias("units"), first("period").alias("periods"), F.count_if(F.col("k") == "label").alias("metric_alias_count"), first("label").alias("metric_alias_examples"))


def reconcile(records: DataFrame) -> DataFrame:
    """task_id, metric, period, matched, delta of metrics that two roles or more state.

    ``records`` has task_id, metric, period, value, role. Values match if they differ by at most 1 or one per
    cent of the largest. Units don't take part.
    """
    keyed = records.select("task_id", F.lower(normalize_text("metric")).alias("metric"), normalize_text("period").alias("period"), "value", "role").where("metric <> '' and value is not null")
    g = keyed.groupBy("task_id", "metric", "period").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    spread = F.col("hi") - F.col("lo")
    most = F.greatest(F.abs("hi"), F.abs("lo"))
    return g.where("n >= 2 and roles >= 2").select("task_id", "metric", "period", (spread <= F.greatest(F.lit(ABSOLUTE), most * RELATIVE)).alias("matched"), F.round(spread, 6).alias("delta"))


def conflict_report(found: DataFrame, records: DataFrame) -> DataFrame:
    """task_id, matched_metric_count, conflict_count, conflicts (the first twenty with five records each), truncated."""
    keyed = records.select("task_id", F.lower(normalize_text("metric")).alias("metric"), normalize_text("period").alias("period"), "value", "role")
    rank = F.row_number().over(Window.partitionBy("task_id", "metric", "period").orderBy("role", "value"))
    few = keyed.join(found.where("not matched"), ["task_id", "metric", "period"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= SHOWN_RECORDS)
    lists = few.groupBy("task_id", "metric", "period").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "value"))).alias("values"))
    each = found.join(lists, ["task_id", "metric", "period"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("task_id", "matched").orderBy("metric", "period")))
    shown = F.array_sort(F.collect_list(F.when(~F.col("matched") & (F.col("rank") <= SHOWN_CONFLICTS), F.struct("rank", "metric", "period", "delta", "values"))))
    g = each.groupBy("task_id").agg(F.count_if("matched").alias("matched_metric_count"), F.count_if(~F.col("matched")).alias("conflict_count"), shown.alias("conflicts"))
    return g.withColumn("truncated", F.col("conflict_count") > SHOWN_CONFLICTS)
