"""Deterministic repair of OCR damage in numeric cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fix_ocr_digits, has_digit, let, normalize_text, parse_cell, repair_confidence, strip_context_unit

# Fixed values.
DIGIT_BASE, UNIT_BASE, LOGGED, SHOWN_PEERS = 0.72, 0.82, 50, 3
# End of fixed values.
ROW = ["task_id", "table_seq", "row_seq"]


def candidate(raw: Column | str, units: Column | str) -> Column:
    """struct<text, value, reason, base> of a repair, or null: confused letters as digits, then units of the context cut.

    Each step is bound once and later ones run only where the earlier ones gave no number.
    """
    units = F.col(units) if isinstance(units, str) else units
    made = lambda t, value, reason, base: F.struct(t.alias("text"), value.alias("value"), reason.alias("reason"), F.lit(base).alias("base"))

    def cut_units(text: Column, digits: Column) -> Column:
        reason = F.when(digits != text, "contextual_ocr_unit_suffix").otherwise("contextual_unit_suffix")
        return let(strip_context_unit(digits, units), lambda s: let(parse_cell(s), lambda v: F.when((s != digits) & v.isNotNull(), made(s, v, reason, UNIT_BASE))))

    def confused(text: Column, digits: Column) -> Column:
        return let(parse_cell(digits), lambda v: F.when((digits != text) & v.isNotNull(), made(digits, v, F.lit("ocr_digit_confusion"), DIGIT_BASE)))

    fix = lambda text: let(fix_ocr_digits(text), lambda digits: F.coalesce(confused(text, digits), cut_units(text, digits)))
    return let(normalize_text(raw), lambda text: F.when(parse_cell(text).isNull() & has_digit(text), fix(text)))


def fixes(df: DataFrame, raw: Column | str, units: Column | str) -> DataFrame:
    """The rows of ``df`` that have a repair, with fix. A generator makes it, as a filter on it would be pushed below and evaluate it twice."""
    return df.withColumn("fix", F.explode(F.array_compact(F.array(candidate(raw, units)))))


def context_evidence(seen: DataFrame) -> Column:
    """The record of what a repair was based on, with the first three peers."""
    text = lambda c, name: normalize_text(c).alias(name)
    return F.struct(
        F.col("name").alias("table"), "title", text("unit", "unit"), text("footnote", "footnote"), text("period", "period"), text("item", "row"),
        F.struct(F.col("page"), F.col("bbox")).alias("row_evidence"), F.struct("page_start", "page_end", F.col("table_bbox").alias("bbox")).alias("table_evidence"), F.slice("peers", 1, SHOWN_PEERS).alias("peer_values"),
    )


def repair_cells(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with repairs made, the repairs). A cell's peers are the other periods' values of its row, repaired ones to its left too."""
    t = tables.select("task_id", "table_seq", "name", "title", "unit", "footnote", "page_start", "page_end", F.col("bbox").alias("table_bbox"))
    r = rows.select(*ROW, "item", "page", "bbox")
    joined = cells.join(r, ROW).join(t, ["task_id", "table_seq"])
    units = F.concat_ws(" ", F.nullif(normalize_text("unit"), F.lit("")), F.nullif(normalize_text("footnote"), F.lit("")))
    tried = joined.withColumn("fix", F.when(F.col("value").isNull(), candidate("raw", units)))
    row = Window.partitionBy(*ROW).orderBy("cell_index")
    entry = lambda value: F.when(value.isNotNull(), F.struct("cell_index", "period", value.alias("value")))
    known = F.collect_list(entry(F.col("value"))).over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = F.collect_list(entry(F.col("fix.value"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    peers = F.filter(F.array_sort(F.concat(known, left)), lambda p: p["period"] != F.col("period"))
    seen = tried.withColumn("peers", peers)
    used = F.array_compact(F.array(
        F.when(normalize_text("unit") != "", "table_unit"), F.when(normalize_text("footnote") != "", "table_footnote"), F.when(normalize_text("period") != "", "period_header"), F.when(normalize_text("item") != "", "row_label"),
        F.when(F.coalesce(F.col("page").cast("string"), "bbox", F.col("page_start").cast("string"), "table_bbox").isNotNull(), "source_evidence"), F.when(F.size("peers") > 0, "peer_period_values"),
    ))
    seen = seen.withColumn("context_used", F.when(F.size(used) > 0, used).otherwise(F.array(F.lit("cell_text"))))
    fixed = F.col("fix").isNotNull()
    kept = seen.select(*ROW, "cell_index", "period", F.when(fixed, F.col("fix.text")).otherwise(F.col("raw")).alias("raw"), F.when(fixed, F.col("fix.value")).otherwise(F.col("value")).alias("value"))
    repairs = seen.where(fixed).select(*ROW, "cell_index", F.col("name").alias("table"), F.col("item").alias("row"), "period", normalize_text("raw").alias("original"), F.col("fix.text").alias("repaired"), F.col("fix.value").alias("value"), F.col("fix.reason").alias("reason"), repair_confidence(F.col("context_used"), F.col("fix.base")).alias("confidence"), "context_used", F.slice("peers", 1, SHOWN_PEERS).alias("peer_values"), context_evidence(seen).alias("context_evidence"))
    return kept, repairs


def repair_log(repairs: DataFrame) -> DataFrame:
    """task_id, repair_count, repairs (the first 50 in order), truncated: the report of each task that has any."""
    order = Window.partitionBy("task_id").orderBy("table_seq", "row_seq", "cell_index")
    ranked = repairs.withColumn("rank", F.row_number().over(order))
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= LOGGED, F.struct("rank", "table", "row", "period", "original", "repaired", "reason", "confidence"))))
    return ranked.groupBy("task_id").agg(F.count("*").alias("repair_count"), shown.alias("repairs")).withColumn("truncated", F.col("repair_count") > LOGGED)
