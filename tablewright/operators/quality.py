"""Checks of tables and their roll-up: coverage, component sums, warnings, risk and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import financial_relevance, looks_numeric, normalize_text, safe_ratio
from ..session import dealt

# Fixed values.
SUM_TOLERANCE = 1e-6
SHOWN_CELLS, TERM_ROWS = 5, 25
NUMERIC_GOOD, EVIDENCE_GOOD, FINANCIAL = 0.95, 0.9, 0.5
WARNINGS = {
    "no_tables": "No structured tables were produced.",
    "failed": "One or more numeric consistency checks failed.",
    "no_periods": "At least one table is missing explicit period headers.",
    "no_unit": "At least one table is missing an explicit unit or scale.",
}
ACTIONS = {
    "no_tables": "Rerun with OCR or remote VLM/hybrid backend to improve table recall.",
    "failed": "Review failed sum checks and rerun affected pages with stricter parsing.",
    "numeric": "Apply numeric repair for OCR-confused digits and footnote markers.",
    "evidence": "Preserve page and bbox evidence for rows missing source references.",
    "no_unit": "Infer or confirm units from nearby paragraphs and table footnotes.",
    "no_periods": "Infer or confirm period headers from multi-level table headers.",
}
DETAILS = {"unfound": "Referenced component rows were not found in the same table.", "sum": "Component rows match the referenced total row.", "parse": "Numeric-looking cells could not be parsed: ", "present": "Table loaded successfully."}
# End of fixed values.
KEY = ["task_id", "table_seq"]
CHECK = "task_id long, table_seq long, type string, row string, status string, detail string"


def row_index(rows: DataFrame, n: int = 0) -> DataFrame:
    """Rows by lower-cased label, the last of equal labels: task_id, table_seq, label, row_seq. ``n``: how many rows there are, if known."""
    labelled = rows.select(*KEY, F.lower(normalize_text("item")).alias("label"), "row_seq").where("label <> ''")
    return (dealt(labelled, n, *KEY, "label") if n else labelled).groupBy(*KEY, "label").agg(F.max("row_seq").alias("row_seq"))


def component_sums(rows: DataFrame, cells: DataFrame, tolerance: float = SUM_TOLERANCE) -> DataFrame:
    """A check for each row with components: does each period's total equal the sum of the component rows?

    Components that aren't found are left out, unless none is (warn); one named twice counts twice.
    Periods without a total or without any component value are skipped. Equal periods of a row: the last.
    Each join is dealt by its keys over a number of tasks that grows with the rows.
    """
    totals = rows.where(F.size("components") > 0)
    detail_of = lambda d, status, detail: d.select(*KEY, F.lit("sum_check").alias("type"), F.col("item").alias("row"), status.alias("status"), detail.alias("detail"))
    named = totals.select(F.sum(F.size("components").cast("long"))).first()[0]
    if not named:
        return detail_of(rows.where(F.lit(False)), F.lit(""), F.lit(""))
    n, row, part = max(named, rows.count()), [*KEY, "row_seq"], [*KEY, "component_seq"]
    wanted = totals.select(*row, "item", F.explode("components").alias("component")).where(normalize_text("component") != "")
    index = row_index(rows, n).withColumnRenamed("row_seq", "component_seq")
    linked = dealt(wanted.select(*row, "item", F.lower(normalize_text("component")).alias("label")), n, *KEY, "label").join(index, [*KEY, "label"], "left")
    values = dealt(cells.select(*row, "cell_index", "period", "value"), n, *row).groupBy(*row, "period").agg(F.max_by("value", "cell_index").alias("value")).where("value is not null")
    parts = dealt(linked.where("component_seq is not null").select(*row, "component_seq"), n, *part).join(values.withColumnRenamed("row_seq", "component_seq"), part)
    sums = dealt(parts.select(*row, "period", "value"), n, *row, "period").groupBy(*row, "period").agg(F.sum("value").alias("total"))
    compared = sums.join(dealt(values, n, *row, "period"), [*row, "period"]).where(F.abs(F.col("value") - F.col("total")) > tolerance)
    text = F.format_string("%s: expected %s, got %s", "period", F.col("value").cast("string"), F.col("total").cast("string"))
    wrong = dealt(compared, n, *row).groupBy(*row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("period", text.alias("text")))), lambda x: x["text"]), "; ").alias("wrong"))
    each = dealt(linked.select(*row, "item", "component_seq"), n, *row).groupBy(*row, "item").agg(F.count("component_seq").alias("found")).join(wrong, row, "left")
    status = F.when(F.col("found") == 0, "warn").when(F.col("wrong").isNotNull(), "fail").otherwise("pass")
    return detail_of(each, status, F.when(F.col("found") == 0, DETAILS["unfound"]).otherwise(F.coalesce("wrong", F.lit(DETAILS["sum"]))))


def numeric_parse_checks(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """A warning for each row with cells that look like numbers and aren't parsed; the first five are shown."""
    odd = cells.where(F.col("value").isNull() & looks_numeric("raw"))
    shown = odd.groupBy(*KEY, "row_seq").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("cell_index", normalize_text("raw").alias("text")))), lambda x: x["text"]), 1, SHOWN_CELLS).alias("cells"))
    return shown.join(rows.select(*KEY, "row_seq", "item"), [*KEY, "row_seq"]).select(*KEY, F.lit("numeric_parse").alias("type"), F.col("item").alias("row"), F.lit("warn").alias("status"), F.concat(F.lit(DETAILS["parse"]), F.array_join("cells", ", ")).alias("detail"))


def verify(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """All checks; a table without any other passes as present."""
    some = numeric_parse_checks(rows, cells).unionByName(component_sums(rows, cells))
    present = tables.select(*KEY).join(some.select(*KEY), KEY, "left_anti")
    return some.unionByName(present.select(*KEY, F.lit("table_presence").alias("type"), F.lit(None).cast("string").alias("row"), F.lit("pass").alias("status"), F.lit(DETAILS["present"]).alias("detail")))


def table_diagnostics(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts and coverages of each table."""
    told = cells.where(normalize_text("raw") != "").select(*KEY, looks_numeric("raw").alias("like"), F.col("value").isNotNull().alias("parsed"))
    of_cells = told.groupBy(*KEY).agg(F.count("*").alias("raw_cell_count"), F.count_if("like").alias("numeric_like_cell_count"), F.count_if(F.col("like") & F.col("parsed")).alias("parsed_numeric_cell_count"))
    items = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("row_seq", normalize_text("item").alias("item")))), 1, TERM_ROWS), lambda x: x["item"]), " ")
    of_rows = rows.groupBy(*KEY).agg(F.count("*").alias("row_count"), F.count_if(F.col("page").isNotNull() | F.col("bbox").isNotNull()).alias("rows_with_evidence"), items.alias("labels"))
    counts = ["row_count", "raw_cell_count", "numeric_like_cell_count", "parsed_numeric_cell_count", "rows_with_evidence"]
    d = tables.join(of_cells, KEY, "left").join(of_rows, KEY, "left").fillna(0, counts)
    return d.select(
        *KEY, "name", "title", "table_type", "page_start", "page_end", *counts,
        F.round(safe_ratio(F.col("parsed_numeric_cell_count"), F.col("numeric_like_cell_count")), 4).alias("numeric_parse_coverage"),
        F.round(safe_ratio(F.col("rows_with_evidence"), F.col("row_count")), 4).alias("evidence_coverage"),
        (F.size("periods") > 0).alias("has_periods"), (normalize_text("unit") != "").alias("has_unit"),
        financial_relevance(F.lower(F.concat_ws(" ", normalize_text("name"), normalize_text("title"), F.coalesce("labels", F.lit(""))))).alias("financial_relevance"),
    )


def risk_level(tables: Column, failed: Column, parse_warnings: Column, n_warnings: Column, numeric: Column, evidence: Column) -> Column:
    return F.when((tables == 0) | (failed > 0), "high").when((parse_warnings > 0) | (numeric < NUMERIC_GOOD) | (evidence < EVIDENCE_GOOD) | (n_warnings > 0), "medium").otherwise("low")


def recommended_actions(tables: Column, failed: Column, parse_warnings: Column, no_unit: Column, no_periods: Column, numeric: Column, evidence: Column) -> Column:
    return F.array_compact(F.array(
        F.when(tables == 0, ACTIONS["no_tables"]),
        F.when(failed > 0, ACTIONS["failed"]),
        F.when((parse_warnings > 0) | (numeric < NUMERIC_GOOD), ACTIONS["numeric"]),
        F.when(evidence < EVIDENCE_GOOD, ACTIONS["evidence"]),
        F.when(no_unit, ACTIONS["no_unit"]),
        F.when(no_periods, ACTIONS["no_periods"]),
    ))


def quality(tasks: DataFrame, diagnostics: DataFrame, checks: DataFrame) -> DataFrame:
    """The quality record of each of ``tasks`` (task_id), from table diagnostics and checks."""
    d = diagnostics.groupBy("task_id").agg(
        F.count("*").alias("table_count"), *[F.sum(c).alias(c) for c in ("row_count", "raw_cell_count", "numeric_like_cell_count", "parsed_numeric_cell_count", "rows_with_evidence")],
        F.count_if(F.col("financial_relevance") >= FINANCIAL).alias("financial_table_count"), F.bool_or(~F.col("has_periods")).alias("no_periods"), F.bool_or(~F.col("has_unit")).alias("no_unit"),
    )
    c = checks.groupBy("task_id").agg(F.count("*").alias("check_count"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")], F.count_if(F.col("type") == "numeric_parse").alias("parse_warnings"))
    counts = [x for x in [*d.columns, *c.columns] if x not in ("task_id", "no_periods", "no_unit")]
    q = tasks.select("task_id").join(d, "task_id", "left").join(c, "task_id", "left").fillna(0, counts).fillna(False, ["no_periods", "no_unit"])
    warnings = F.array_compact(F.array(F.when(F.col("table_count") == 0, WARNINGS["no_tables"]), F.when(F.col("n_fail") > 0, WARNINGS["failed"]), F.when(F.col("no_periods"), WARNINGS["no_periods"]), F.when(F.col("no_unit"), WARNINGS["no_unit"])))
    q = q.withColumn("warnings", warnings)
    numeric, evidence = safe_ratio(F.col("parsed_numeric_cell_count"), F.col("numeric_like_cell_count")), safe_ratio(F.col("rows_with_evidence"), F.col("row_count"))
    hard, n_warn = F.col("n_pass") + F.col("n_fail"), F.col("n_warn") + F.size("warnings")
    args = (F.col("table_count"), F.col("n_fail"), F.col("parse_warnings"))
    return q.select(
        "task_id", F.when(hard == 0, 1.0).otherwise(F.round(F.col("n_pass") / F.nullif(hard, F.lit(0)), 4)).alias("validation_pass_rate"), "check_count", hard.alias("hard_check_count"), F.col("n_pass").alias("passed_count"),
        n_warn.cast("long").alias("warning_count"), F.col("n_fail").alias("failed_count"), (n_warn + F.col("n_fail")).cast("long").alias("issue_count"), "warnings",
        risk_level(*args, F.size("warnings"), numeric, evidence).alias("risk_level"), "table_count", "row_count", "raw_cell_count", "numeric_like_cell_count", "parsed_numeric_cell_count",
        F.round(numeric, 4).alias("numeric_parse_coverage"), F.round(evidence, 4).alias("evidence_coverage"), "financial_table_count",
        recommended_actions(*args, F.col("no_unit"), F.col("no_periods"), numeric, evidence).alias("recommended_actions"),
    )


def quality_summary(q: DataFrame) -> DataFrame:
    """What a trace tells of a quality record."""
    return q.select("task_id", "failed_count", "warning_count", "risk_level", "table_count", "numeric_parse_coverage", "evidence_coverage")


def attach_context(q: DataFrame, context: DataFrame, report: DataFrame) -> DataFrame:
    """``q`` with shared_context and cross_file_checks as structs, null for tasks without."""
    packed = lambda d, name: d.select("task_id", F.struct(*[c for c in d.columns if c != "task_id"]).alias(name))
    return q.join(packed(context, "shared_context"), "task_id", "left").join(packed(report, "cross_file_checks"), "task_id", "left")


def summary(q: DataFrame, repairs: DataFrame) -> DataFrame:
    """A sentence for each task, from its quality and its repair log (task_id, repair_count)."""
    n = F.coalesce("repair_count", F.lit(0))
    rate = F.format_string("%.2f%%", F.col("validation_pass_rate") * 100)
    said = F.format_string("Parsed %d tables with %d rows. Validation pass rate: %s. Warnings: %d; failures: %d; repairs: %d.", "table_count", "row_count", rate, "warning_count", "failed_count", n)
    return q.join(repairs.select("task_id", "repair_count"), "task_id", "left").select("task_id", said.alias("summary"))
