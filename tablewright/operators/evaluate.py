"""Scores against expectations, and the aggregates of benchmark reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ci, let, normalize_text
from ..session import stored
from .structure import cells_of, lines_of, nested, unfolded

# Fixed values.
THRESHOLDS = [("min_table_count", "table_count", ">="), ("min_row_count", "row_count", ">="), ("max_failed_count", "failed_count", "<="), ("max_warning_count", "warning_count", "<="), ("min_validation_pass_rate", "validation_pass_rate", ">=")]
LAYOUT_METRICS = ["header_precision", "header_recall", "row_precision", "row_recall", "numeric_exact_match", "cross_page_merge_accuracy", "unit_inheritance_accuracy"]
METRIC_TOLERANCE = 1e-6
# End of fixed values.


def threshold_checks(quality: DataFrame, expected: DataFrame) -> DataFrame:
    """task_id, name, observed, expected, status: a check for each threshold that ``expected`` (a column each) sets."""
    both = quality.join(expected, "task_id")
    each = [F.struct(F.lit(n).alias("name"), F.col(o).cast("double").alias("observed"), F.col(n).cast("double").alias("expected"), F.lit(op).alias("op")) for n, o, op in THRESHOLDS if n in expected.columns]
    checks = both.select("task_id", F.explode(F.array(*each)).alias("c")).select("task_id", "c.*").where("expected is not null")
    ok = F.when(F.col("op") == ">=", F.col("observed") >= F.col("expected")).otherwise(F.col("observed") <= F.col("expected"))
    return checks.select("task_id", "name", "observed", "expected", F.when(ok, "pass").otherwise("fail").alias("status"))


def required_tables(tables: DataFrame, required: DataFrame) -> DataFrame:
    """task_id, token, status for each (task_id, token): is there a table whose name or title has the token?"""
    hit = required.join(tables.select("task_id", "name", "title"), "task_id", "left").groupBy("task_id", "token").agg(F.bool_or(F.col("name").isNotNull() & (contains_ci("name", "token") | contains_ci("title", "token"))).alias("hit"))
    return hit.select("task_id", "token", F.when(F.col("hit"), "pass").otherwise("fail").alias("status"))


def required_metrics(cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """metric_id, observed, status: the first cell in order within the tolerance decides.

    ``cells`` has task_id, table, title, unit, item, period, value, has_evidence and ``seq`` (an orderable
    column); ``metrics`` task_id, metric_id, table_contains, row_contains, unit_contains, period,
    expected_value, tolerance, evidence_required. Null conditions don't restrict. A match without
    evidence fails where evidence is required.
    """
    asked = metrics.select("task_id", _asked(metrics).alias("m"))
    return _metric_verdicts(metrics, cells.join(asked, "task_id"))


def _asked(metrics: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in metrics.columns if c != "task_id"])


def _metric_verdicts(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """metric_id, observed, status from ``pairs``: cells beside a metric of their task, which is a struct ``m``."""
    open_ = lambda token, hit: F.coalesce(F.col(token) == "", F.lit(True)) | hit
    fits = (
        (F.abs(F.col("value") - F.col("m.expected_value")) <= F.coalesce(F.col("m.tolerance"), F.lit(0.0)))
        & open_("m.period", F.col("period") == F.col("m.period"))
        & open_("m.table_contains", contains_ci("table", "m.table_contains") | contains_ci("title", "m.table_contains"))
        & open_("m.row_contains", contains_ci("item", "m.row_contains"))
        & open_("m.unit_contains", contains_ci("unit", "m.unit_contains"))
    )
    hits = pairs.where(fits).groupBy(F.col("m.metric_id").alias("metric_id")).agg(F.min_by(F.struct("value", "has_evidence"), "seq").alias("hit"))
    each = metrics.join(hits, "metric_id", "left")
    ok = F.col("hit").isNotNull() & (~F.coalesce("evidence_required", F.lit(False)) | F.col("hit.has_evidence"))
    return each.select("metric_id", F.col("hit.value").alias("observed"), F.when(ok, "pass").otherwise("fail").alias("status"))


def score(checks: DataFrame, key: str = "task_id") -> DataFrame:
    """key, passed_count, check_count, score, status: a task passes if all its checks do."""
    g = checks.groupBy(key).agg(F.count_if(F.col("status") == "pass").alias("passed_count"), F.count("*").alias("check_count"))
    return g.select(key, "passed_count", "check_count", F.round(F.col("passed_count") / F.col("check_count"), 4).alias("score"), F.when(F.col("passed_count") == F.col("check_count"), "pass").otherwise("fail").alias("status"))


def set_match(expected: DataFrame, observed: DataFrame, key: str, label: str) -> DataFrame:
    """key, matched, n_expected, n_observed, precision, recall of labels; duplicates among the expected count."""
    hit = expected.join(observed.select(key, label).distinct().withColumn("hit", F.lit(1)), [key, label], "left").groupBy(key).agg(F.count("hit").alias("matched"), F.count("*").alias("n_expected"))
    n = observed.groupBy(key).agg(F.count("*").alias("n_observed"))
    each = hit.join(n, key, "left").fillna(0, ["n_observed"])
    ratio = lambda d: F.when(F.col(d) > 0, F.round(F.col("matched") / F.nullif(F.col(d), F.lit(0)), 4)).otherwise(1.0)
    return each.select(key, "matched", "n_expected", "n_observed", ratio("n_observed").alias("precision"), ratio("n_expected").alias("recall"))


def value_match(expected: DataFrame, observed: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Of ``expected`` (keys, value) how many have an observed value within the tolerance: matched, n_expected."""
    o = observed.select(*keys, F.col("value").alias("seen"))
    best = expected.join(o, keys, "left").groupBy(*keys, "value").agg(F.bool_or(F.abs(F.col("seen") - F.col("value")) <= tolerance).alias("hit"))
    return best.agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("matched"), F.count("*").alias("n_expected"))


def forbidden_rows(rows: DataFrame, forbidden: DataFrame) -> DataFrame:
    """task_id, token, status: a forbidden label fails if any row has it."""
    hit = forbidden.join(rows.select("task_id", "item"), "task_id", "left").groupBy("task_id", "token").agg(F.bool_or(F.coalesce(contains_ci("item", "token") & F.col("item").isNotNull(), F.lit(False))).alias("hit"))
    return hit.select("task_id", "token", F.when(F.col("hit"), "fail").otherwise("pass").alias("status"))


def missing_periods(tables: DataFrame, expected: DataFrame) -> DataFrame:
    """task_id, missing, status from expected (task_id, periods)."""
    both = expected.select("task_id", F.col("periods").alias("wanted")).join(tables.groupBy("task_id").agg(F.array_distinct(F.flatten(F.collect_list("periods"))).alias("have")), "task_id", "left")
    missing = F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>")))
    return both.select("task_id", missing.alias("missing"), F.when(F.size(missing) == 0, "pass").otherwise("fail").alias("status"))


def method_summary(reports: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """method, reports, sums and rounded means over reports that aren't skipped; nulls don't count, no values give null."""
    kept = reports.where(~F.coalesce("skipped", F.lit(False))) if "skipped" in reports.columns else reports
    return kept.groupBy("method").agg(F.count("*").alias("reports"), *[F.sum(c).alias(c) for c in sums], *[F.round(F.avg(c), 4).alias(c) for c in means])


def method_delta(summary: DataFrame, left: str, right: str, columns: list[str]) -> DataFrame:
    """left minus right of each column in one row; null where either is."""
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return summary.agg(*[F.round(of(left, c) - of(right, c), 4).alias(c) for c in columns])


def soak_stats(runs: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, least, median, mean, p95 (nearest rank, halves to even), most of a value. Values are counted before they are ranked."""
    counts = runs.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    of_key = Window.partitionBy(key)
    ranked = counts.withColumn("upto", F.sum("c").over(of_key.orderBy("x"))).withColumn("n", F.sum("c").over(of_key))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("x")))
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    p95 = at(F.bround((F.col("n") - 1) * F.lit(0.95), 0) + 1)
    return ranked.groupBy(key).agg(F.sum("c").alias("n"), F.min("x").alias("least"), middle.alias("median"), F.round(F.sum(F.col("x") * F.col("c")) / F.sum("c"), 4).alias("mean"), p95.alias("p95"), F.max("x").alias("most"))


def first_containing(tables: DataFrame, tokens: DataFrame) -> DataFrame:
    """task_id, token, table_seq: the first table whose name or title has the token."""
    hit = tokens.join(tables.select("task_id", "table_seq", "name", "title"), "task_id").where(contains_ci("name", "token") | contains_ci("title", "token"))
    return hit.groupBy("task_id", "token").agg(F.min("table_seq").alias("table_seq"))


def metric_cells(t, whole: DataFrame | None = None) -> DataFrame:
    """The cells of :class:`.structure.Tables` as :func:`required_metrics` takes them, with any other columns of ``whole``. Evidence is a page or box of the row or the table."""
    known = nested(t)
    whole = known if whole is None else whole
    told = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("page", "bbox", "page_start", "table_bbox")])
    more = [c for c in whole.columns if c not in known.columns]
    return unfolded(lines_of(whole)).select("task_id", F.col("name").alias("table"), "title", "unit", "item", "period", "value", told.alias("has_evidence"), F.struct("table_seq", "row_seq", "cell_index").alias("seq"), *more)


def evaluate_results(t, quality: DataFrame, expected: DataFrame, tokens: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checks (task_id, name, what, status) and scores of results against expectations.

    ``expected`` has task_id and a column for each threshold, ``tokens`` (task_id, token) names required tables,
    ``metrics`` is as in :func:`required_metrics`. A task passes if all its checks do; one without checks
    scores 1.
    """
    limits = threshold_checks(quality, expected).select("task_id", "name", F.col("expected").cast("string").alias("what"), "status")
    named = required_tables(t.tables, tokens).select("task_id", F.lit("required_table").alias("name"), F.col("token").alias("what"), "status")
    # Metrics meet whole tables, which are opened there.
    pairs = metric_cells(t, nested(t).join(metrics.select("task_id", _asked(metrics).alias("m")), "task_id"))
    found = _metric_verdicts(metrics, pairs).join(metrics.select("metric_id", "task_id"), "metric_id").select("task_id", F.lit("required_metric").alias("name"), F.col("metric_id").cast("string").alias("what"), "status")
    checks = limits.unionByName(named).unionByName(found)
    scores = expected.select("task_id").distinct().join(score(checks), "task_id", "left").fillna(0, ["passed_count", "check_count"])
    return checks, scores.withColumns({"score": F.coalesce("score", F.lit(1.0)), "status": F.coalesce("status", F.lit("pass"))})


def expectations_of(results: DataFrame, expected: DataFrame, key: str | None = None) -> DataFrame:
    """``expected`` (task_key, ...) of each result (task_id, task_name): by ``key``, else by task_name, else by task_id."""
    wanted = F.lit(key) if key else F.coalesce(F.nullif(F.col("task_name"), F.lit("")), F.col("task_id").cast("string"))
    return results.select("task_id", wanted.alias("task_key")).join(expected, "task_key").drop("task_key")


def method_row(quality: DataFrame, scores: DataFrame, method: str) -> DataFrame:
    """task_id, method, what quality and score say: a line of a benchmark's or an adversarial summary."""
    s = scores.select("task_id", *[F.col(c).alias(f"expectation_{c}") for c in ("score", "status", "passed_count", "check_count")])
    kept = ["table_count", "row_count", "failed_count", "warning_count", "validation_pass_rate", "numeric_parse_coverage", "evidence_coverage", "financial_table_count"]
    return quality.select("task_id", F.lit(method).alias("method"), *kept).join(s, "task_id", "left")


def required_metric_counts(checks: DataFrame) -> DataFrame:
    """task_id, required_metric_count, required_metric_passed."""
    of = checks.where("name = 'required_metric'").groupBy("task_id")
    return of.agg(F.count("*").alias("required_metric_count"), F.count_if(F.col("status") == "pass").alias("required_metric_passed"))


def case_tables(tables: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, task_id, expected_table, ...) with the first table whose name or title has expected_table; null without."""
    hits = first_containing(tables, cases.select("task_id", F.col("expected_table").alias("token")).distinct()).withColumnRenamed("token", "expected_table")
    return cases.join(hits, ["task_id", "expected_table"], "left")


def _label(c: Column | str) -> Column:
    return F.lower(normalize_text(c))


def _values_seen(whole: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """case_id, label, period, seen: the value in each of ``wanted`` (case_id, label, period) in the table of its case, as far as there is one.

    Of equal labels and of equal periods the last counts. Tables are opened where their case is, so only
    rows that a case asks for leave the nested form.
    """
    asked = wanted.groupBy("case_id").agg(F.collect_set("label").alias("asked"))
    opened = found.select("case_id", "task_id", "table_seq").join(asked, "case_id").join(whole.select("task_id", "table_seq", "lines"), ["task_id", "table_seq"])
    kept = F.array_compact(F.transform("lines", lambda x: let(_label(x["item"]), lambda label: F.when(F.array_contains("asked", label), F.struct(label.alias("label"), x.alias("line"))))))
    lines = opened.select("case_id", F.explode(kept).alias("l")).select("case_id", "l.*")
    last = lines.groupBy("case_id", "label").agg(F.max_by("line", F.col("line.row_seq")).alias("line"))
    cells = last.select("case_id", "label", F.explode(cells_of(F.col("line"), whole)).alias("c"))
    return cells.groupBy("case_id", "label", F.col("c.period").alias("period")).agg(F.max_by("c.value", "c.cell_index").alias("seen"))


def layout_report(t, cases: DataFrame, periods: DataFrame, rows: DataFrame, values: DataFrame) -> DataFrame:
    """case_id, seven metrics and status of layout cases.

    ``cases`` has case_id, task_id, expected_table, expected_unit, page_start, page_end; ``periods`` and ``rows``
    (case_id, label), ``values`` (case_id, row, period, value, tolerance) what is expected. A metric without
    expectations is null; a case passes if no metric is below 1. A case whose table isn't found has matches of 0.
    """
    found, whole = stored(case_tables(t.tables, cases)), nested(t)
    of = found.select("case_id", "task_id", "table_seq")
    have_periods = of.join(t.tables.select("task_id", "table_seq", F.explode("periods").alias("p")), ["task_id", "table_seq"]).select("case_id", _label("p").alias("label"))
    have_rows = of.join(whole.select("task_id", "table_seq", "lines"), ["task_id", "table_seq"]).select("case_id", F.explode(F.transform("lines", lambda x: _label(x["item"]))).alias("label"))
    ratio = lambda d, head: d.select("case_id", F.col("precision").alias(f"{head}_precision"), F.col("recall").alias(f"{head}_recall"))
    told = lambda d: d.select("case_id", _label("label").alias("label"))
    header = ratio(set_match(told(periods), have_periods, "case_id", "label"), "header")
    lines = ratio(set_match(told(rows), have_rows, "case_id", "label"), "row")
    want = values.select("case_id", _label("row").alias("label"), "period", "value", F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"))
    exact = want.join(_values_seen(whole, found, want), ["case_id", "label", "period"], "left").groupBy("case_id").agg(F.round(F.count_if(F.coalesce(F.abs(F.col("seen") - F.col("value")) <= F.col("tolerance"), F.lit(False))) / F.count("*"), 4).alias("numeric_exact_match"))
    held = found.join(t.tables.select("task_id", "table_seq", "unit", F.col("page_start").alias("at"), F.col("page_end").alias("to")), ["task_id", "table_seq"], "left")
    paged = F.col("page_start").isNotNull() | F.col("page_end").isNotNull()
    span = F.col("at").eqNullSafe(F.col("page_start")) & F.col("to").eqNullSafe(F.col("page_end"))
    of_unit = F.col("table_seq").isNotNull() & contains_ci("unit", "expected_unit")
    each = held.select("case_id", F.when(paged, F.when(span, 1.0).otherwise(0.0)).alias("cross_page_merge_accuracy"), F.when(normalize_text("expected_unit") != "", F.when(of_unit, 1.0).otherwise(0.0)).alias("unit_inheritance_accuracy"))
    every = each.join(header, "case_id", "left").join(lines, "case_id", "left").join(exact, "case_id", "left")
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(m) >= 1, F.lit(True)) for m in LAYOUT_METRICS])
    return every.select("case_id", *LAYOUT_METRICS, F.when(whole, "pass").otherwise("fail").alias("status"))


def aggregate_cases(cases: DataFrame, means: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """One row: status, case_count, passed_count, means that ignore nulls, sums."""
    passed = F.count_if(F.col("status") == "pass")
    return cases.agg(F.when(passed == F.count("*"), "pass").otherwise("fail").alias("status"), F.count("*").alias("case_count"), passed.alias("passed_count"), *[F.round(F.avg(m), 4).alias(m) for m in means], *[F.sum(c).alias(c) for c in sums])


def edge_checks(t, cases: DataFrame, metrics: DataFrame, periods: DataFrame, forbidden: DataFrame, flags: DataFrame, warnings: DataFrame, observed: DataFrame) -> DataFrame:
    """case_id, name, what, status: all checks of edge cases (case_id, task_id, expected_table, expected_warning_type).

    Expected are ``metrics`` (case_id, row, period, value), ``periods`` (case_id, label), ``forbidden``
    (case_id, token) and ``flags`` (case_id, flag, expected); seen are ``warnings`` (task_id, type) and
    ``observed`` flags (task_id, flag, value). Without its table a case's metrics fail, its forbidden rows and periods pass.
    """
    found, whole = stored(case_tables(t.tables, cases)), nested(t)
    of = found.select("case_id", "task_id", "table_seq")
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status")
    check = lambda d, name, what, ok: d.select("case_id", F.lit(name).alias("name"), F.col(what).cast("string").alias("what"), verdict(ok))
    there = check(found, "table_found", "expected_table", F.col("table_seq").isNotNull())
    wanted = metrics.withColumn("label", _label("row"))
    told = wanted.join(_values_seen(whole, found, wanted), ["case_id", "label", "period"], "left")
    exact = check(told, "required_metric", "row", F.abs(F.col("seen") - F.col("value")) <= METRIC_TOLERANCE)
    warned = found.join(warnings.select("task_id", F.col("type").alias("expected_warning_type"), F.lit(True).alias("hit")).distinct(), ["task_id", "expected_warning_type"], "left")
    warning = check(warned, "warning_type", "expected_warning_type", F.col("hit") | (F.coalesce("expected_warning_type", F.lit("")) == ""))
    equal = flags.join(of, "case_id").join(observed, ["task_id", "flag"], "left")
    flag = check(equal, "edge_flag", "flag", F.col("value") == F.col("expected"))
    tokens = forbidden.groupBy("case_id").agg(F.collect_set(F.struct("token")).alias("tokens"))
    opened = tokens.join(of, "case_id", "left").join(whole.select("task_id", "table_seq", F.transform("lines", lambda x: _label(x["item"])).alias("labels")), ["task_id", "table_seq"], "left")
    hit = lambda token: let(F.lower(token), lambda low: F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda label: F.contains(label, low)))
    hits = opened.select("case_id", F.explode(F.transform("tokens", lambda token: F.struct(token["token"].alias("token"), F.coalesce(hit(token["token"]), F.lit(False)).alias("hit")))).alias("x")).select("case_id", "x.*")
    noise = check(hits, "forbidden_row", "token", ~F.col("hit"))
    have = found.join(t.tables.select("task_id", "table_seq", F.transform("periods", lambda p: F.lower(normalize_text(p))).alias("have")), ["task_id", "table_seq"], "left").select("case_id", "have")
    asked = periods.join(have, "case_id")
    period = check(asked, "expected_period", "label", F.col("have").isNull() | F.array_contains("have", _label("label")))
    return reduce(DataFrame.unionByName, [there, exact, warning, flag, noise, period])


def edge_report(checks: DataFrame) -> DataFrame:
    """case_id, status, required_metric_accuracy (1 without any), check_count."""
    metric = F.col("name") == "required_metric"
    g = checks.groupBy("case_id").agg(F.count("*").alias("check_count"), F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(metric).alias("required_metric_count"), F.count_if(metric & (F.col("status") == "pass")).alias("required_metric_passed"))
    accuracy = F.when(F.col("required_metric_count") == 0, 1.0).otherwise(F.round(F.col("required_metric_passed") / F.nullif(F.col("required_metric_count"), F.lit(0)), 4))
    return g.select("case_id", F.when(F.col("fails") == 0, "pass").otherwise("fail").alias("status"), "check_count", "required_metric_count", "required_metric_passed", accuracy.alias("required_metric_accuracy"))


def soak_report(runs: DataFrame) -> DataFrame:
    """One row on many runs of alike tasks: how many succeeded, how long they took, and whether their outputs agree.

    ``runs`` has task_id, status, elapsed, table_count, row_count, failed_count, warning_count,
    numeric_parse_coverage, evidence_coverage, plan_exists, trace_exists, result_exists, result_hash.
    """
    done = F.col("status") == "succeeded"
    kept = F.col("plan_exists") & F.col("trace_exists") & F.col("result_exists")
    shape = F.struct("table_count", "row_count", "failed_count", "warning_count", "numeric_parse_coverage", "evidence_coverage")
    rounded = lambda c: F.round(c, 4)
    g = runs.agg(
        F.count("*").alias("task_count"), F.count_if(done).alias("succeeded_count"), F.count_if(~done).alias("failed_task_count"), rounded(F.count_if(done) / F.nullif(F.count("*"), F.lit(0))).alias("success_rate"),
        rounded(F.count_if(kept) / F.nullif(F.count("*"), F.lit(0))).alias("artifact_coverage"), F.count_distinct(F.when(done, F.col("result_hash"))).alias("unique_result_hash_count"), F.count_distinct(F.when(done, shape)).alias("output_shape_count"),
        F.sum("table_count").alias("total_tables"), F.sum("row_count").alias("total_rows"), F.sum("failed_count").alias("hard_failures"),
    )
    times = soak_stats(runs.withColumn("k", F.lit(1)), "k", "elapsed").select(*[rounded(F.col(c)).alias(f"elapsed_{c}") for c in ("least", "median", "mean", "p95", "most")])
    ok = (F.col("success_rate") == 1) & (F.col("artifact_coverage") == 1)
    one = g.withColumn("k", F.lit(1)).join(times.withColumn("k", F.lit(1)), "k", "left").drop("k")
    return one.withColumns({"status": F.when(ok, "pass").otherwise("fail"), "shape_consistency": F.when(F.col("output_shape_count") == 1, 1.0).otherwise(0.0)})
