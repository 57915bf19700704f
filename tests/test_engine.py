"""The engine on small literal documents."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import evaluate, quality, reconcile, repair, structure
from tablewright.plans import routing, steps
from tablewright.sources import artifacts, html

PAGES = [
    [
        {"type": "title", "content": {"title_content": "Balance Sheet"}},
        {"type": "paragraph", "content": {"paragraph_content": "单位：百万元，人民币"}},
        {"type": "table", "bbox": [0, 0, 9, 9], "content": {"periods": ["2025", "2024"], "rows": [{"label": "Cash", "values": ["1,000", "900"]}, {"label": "Loans", "values": ["2,000", "8OO"]}]}},
    ],
    [
        {"type": "title", "content": {"title_content": "Balance  sheet"}},
        {"type": "table", "content": {"title": "balance sheet", "rows": [{"label": "Total assets", "values": ["3,000", "1,700"], "components": ["Cash", "Loans"]}], "periods": ["2025", "2024"]}},
        {"type": "chart", "content": {"title": "Sales chart", "chart_type": "bar", "periods": ["2024"], "series": [{"name": "Revenue", "values": ["(5)"]}], "annotations": [{"label": "Growth yoy", "percent": "12%", "period": "2024"}]}},
    ],
    [{"type": "text", "text": "As shown, the growth of 2024 and this amount are strong."}],
]


@pytest.fixture(scope="module")
def found(spark):
    blocks = artifacts.flatten_v2(spark.createDataFrame([(1, json.dumps(PAGES)), (2, json.dumps({"type": "text", "text": "over $12.5 billion in annual revenue, up 7 percent"})), (3, "not json")], "task_id long, json string"))
    t = structure.materialize_tables(blocks)
    return structure.Tables(t.tables.cache(), t.rows.cache(), t.cells.cache())


def test_structuring(found):
    tables = {(r.task_id, r["name"]): r for r in found.tables.collect()}
    sheet = tables[1, "balance_sheet"]
    assert (sheet.unit, sheet.page_start, sheet.page_end, sheet.periods) == ("百万元", 0, 1, ["2025", "2024"])
    assert set(tables) == {(1, "balance_sheet"), (1, "sales_chart"), (1, "global_reference_resolution"), (2, "financial_metrics_from_ocr_text")}
    rows = found.rows.where("task_id = 1").orderBy("table_seq", "row_seq").collect()
    assert [r.item for r in rows][:3] == ["Cash", "Loans", "Total assets"]
    cells = {(r.period, r.raw): r.value for r in found.cells.where("task_id = 1").collect()}
    assert cells["2024", "8OO"] is None and cells["2024", "(5)"] == -5 and cells["2024", "12%"] == 12
    told = {r.period: r.value for r in found.cells.where("task_id = 2").collect()}
    assert told == {"amount_usd_billions": 12.5, "year_over_year_percent": 7.0}


def test_references(found):
    seq = found.tables.where("name = 'global_reference_resolution'").first().table_seq
    rows = {r.row_seq: r for r in found.rows.where(F.col("table_seq") == seq).collect()}
    values = {(rows[r.row_seq].item, r.period): r.value for r in found.cells.where(F.col("table_seq") == seq).collect()}
    assert values["the growth", "resolved_value"] == 12 and values["the growth", "confidence"] == 0.96
    assert ("this amount", "resolved_value") in values


def test_checks_quality_and_repair(spark, found):
    every = quality.verify(found.tables, found.rows, found.cells).cache()
    checks = every.where("task_id = 1").collect()
    kinds = sorted((c.type, c.status) for c in checks)
    assert ("numeric_parse", "warn") in kinds and ("sum_check", "fail") in kinds
    assert next(c.detail for c in checks if c.row == "Total assets") == "2024: expected 1700.0, got 900.0"
    d = quality.table_diagnostics(found.tables, found.rows, found.cells)
    q = {r.task_id: r for r in quality.quality(spark.createDataFrame([(1,), (2,), (3,)], "task_id long"), d, every).collect()}
    assert (q[1].risk_level, q[1].failed_count, q[3].risk_level, q[3].table_count, q[3].warnings) == ("high", 1, "high", 0, ["No structured tables were produced."])
    cells, repairs = repair.repair_cells(found.tables, found.rows, found.cells)
    repairs = repairs.cache()
    (r,) = repairs.collect()
    assert (r.original, r.repaired, r.value, r.reason, r.confidence) == ("8OO", "800", 800.0, "ocr_digit_confusion", 0.92)
    assert repair.repair_log(repairs).first().repair_count == 1
    again = quality.component_sums(found.rows, cells).where("task_id = 1 and row = 'Total assets'").collect()
    assert [c.status for c in again] == ["pass"]


def test_partitioning_does_not_matter(spark):
    one = spark.createDataFrame([(1, json.dumps(PAGES))], "task_id long, json string")
    results = []
    for n in (1, 5):
        t = structure.normalize_tables(structure.carry_context(structure.block_texts(structure.classify(artifacts.flatten_v2(one.repartition(n)))), ["task_id"]))
        results.append(sorted(map(str, t.cells.collect())))
    assert results[0] == results[1]


NUMBERS = [("", None), ("--", None), ("N/A", None), ("1,234.5", 1234.5), ("(12%)", -12), ("（3）", -3), ("(7", -7), ("(x", None), ("(-5)", 5), ("$(12)", None), ("RMB 5", 5), ("usd-5", -5), ("9*†", 9), ("1e3", 1000), ("1_000", None), ("1.5d", None), (".5", 0.5), ("5.", 5), ("١", None), (" 1 000 ", 1000), ("￥8，000", 8000), ("inf", float("inf")), ("(", None), ("()", None), (None, None)]


def test_parse_number(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NUMBERS)], "i int, x string")
    got = {r.i: r.v for r in df.select("i", T.parse_number("x").alias("v")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [v for _, v in NUMBERS]


def test_numeric_looks_and_labels(spark):
    cases = [("12", True), ("1O,l", True), ("USD 5 or so", True), ("Mar 2024", False), ("year 2024", False), ("abc 5", False), ("O", False), ("5%", True)]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x string")
    assert [r.v for r in df.select(T.looks_numeric("x").alias("v")).collect()] == [v for _, v in cases]
    row = df.limit(1).select(T.slugify_name(F.lit(" —!")).alias("a"), T.slugify_name(F.lit("É 中-1")).alias("b"), T.safe_int(F.lit("0"), 4).alias("c"), T.safe_int(F.lit("x"), 4).alias("d"), T.input_slug(F.lit(3), F.lit("/a/B c.v1.PDF"), F.lit(None), F.lit("r")).alias("e"), T.year_from_text(F.lit("in 2031 and 1999")).alias("f"), T.strip_context_unit(F.lit("5 usd 万元"), F.lit("人民币万元 USD")).alias("g")).first()
    assert tuple(row) == ("table", "é_中_1", 1, 4, "input_03_b_c_v1", "2031", "5")


def test_html(spark):
    page = "<title>Doc</title><p>Unit: USD, all</p><table><caption>T1</caption><tr><th rowspan=2>Item</th><th colspan=2>FY24</th></tr><tr><th>A</th><th>B</th></tr><tr><td>x<td>(1)<td>2</td></tr><tr><td></td></tr></table><table><tr><td>only</td></tr></table>"
    t = html.html_tables(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id").orderBy("page_idx").collect()
    assert [(r.title, r.unit) for r in t] == [("T1", "USD"), ("Doc", "USD")]
    assert t[0].grid == [["Item", "FY24", "FY24"], ["Item", "A", "B"], ["x", "(1)", "2"]]
    rows = structure.grid_rows(spark.createDataFrame(t).where("page_idx = 0"), ["id"]).collect()
    assert [(r.item, r.raws, r.periods) for r in rows] == [("x", ["(1)", "2"], ["FY24 A", "FY24 B"])]
    assert html.grid([[[["a"], None, "2"], [["b"], None, None]], [[["c"], "2", None]]]) == [["a", "b"], ["a", "c", "c"]]


def test_other_sources(spark):
    flat = artifacts.flatten_legacy(spark.createDataFrame([(1, '{"blocks": [{"type": "a"}, 5]}'), (2, '{"type": "b"}'), (3, '[{"type": "c"}]')], "task_id long, json string"))
    assert sorted((r.task_id, r.block_type) for r in flat.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    data = {"pdf_info": [{"preproc_blocks": [{"type": "a"}]}, {"page_idx": 7, "preproc_blocks": [], "para_blocks": [{"type": "b"}]}]}
    one = spark.createDataFrame([(1, json.dumps(data))], "task_id long, json string")
    assert [(r.page_idx, r.block_type) for r in artifacts.flatten_middle(one).orderBy("block_seq").collect()] == [(0, "a"), (7, "b")]
    assert [r.block_type for r in artifacts.flatten_middle(one, parity=True).collect()] == ["a"]
    both = artifacts.prefer_blocks(artifacts.flatten_middle(one.where("false")), flat)
    assert both.count() == 3
    files = spark.createDataFrame([("/a/x_layout.pdf",), ("/a/layout.pdf",), ("/b/span.pdf",), ("/a/z.md",), ("/a/y.md",)], "path string")
    assert {r.kind: r.path for r in artifacts.pick_artifacts(files).collect()} == {"layout": "/a/x_layout.pdf", "span": "/b/span.pdf", "markdown": "/a/y.md"}
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "task_id long, updated_at int, status string")
    assert sorted((r.task_id, r.status) for r in artifacts.latest_tasks(v).collect()) == [(1, "b"), (2, "c")]


def test_reconcile_and_evaluate(spark):
    rec = spark.createDataFrame([(1, "Cash", "2024", 100.0, "primary"), (1, "cash ", "2024", 101.0, "attachment"), (1, "Debt", "2024", 100.0, "primary"), (1, "debt", "2024", 120.0, "reference"), (1, "Solo", "2024", 1.0, "primary"), (1, "solo", "2024", 9.0, "primary")], "task_id long, metric string, period string, value double, role string")
    found = reconcile.reconcile(rec)
    assert sorted((r.metric, r.matched, r.delta) for r in found.collect()) == [("cash", True, 1.0), ("debt", False, 20.0)]
    report = reconcile.conflict_report(found, rec).first()
    assert (report.matched_metric_count, report.conflict_count, len(report.conflicts[0]["values"])) == (1, 1, 2)
    q = spark.createDataFrame([(1, 2, 5, 0, 3, 0.5)], "task_id long, table_count long, row_count long, failed_count long, warning_count long, validation_pass_rate double")
    exp = spark.createDataFrame([(1, 2, None, 2)], "task_id long, min_table_count int, min_row_count int, max_warning_count int")
    checks = evaluate.threshold_checks(q, exp)
    assert sorted((r["name"], r.status) for r in checks.collect()) == [("max_warning_count", "fail"), ("min_table_count", "pass")]
    assert evaluate.score(checks).first().score == 0.5
    tables = spark.createDataFrame([(1, 0, "balance_sheet", "Balance", ["a"])], "task_id long, table_seq long, name string, title string, periods array<string>")
    req = spark.createDataFrame([(1, "BALANCE"), (1, "cash")], "task_id long, token string")
    assert sorted((r.token, r.status) for r in evaluate.required_tables(tables, req).collect()) == [("BALANCE", "pass"), ("cash", "fail")]
    rows = spark.createDataFrame([(1, "Page header")], "task_id long, item string")
    assert sorted(r.status for r in evaluate.forbidden_rows(rows, spark.createDataFrame([(1, "header"), (1, "x")], "task_id long, token string")).collect()) == ["fail", "pass"]
    assert evaluate.missing_periods(tables, spark.createDataFrame([(1, ["a", "b"])], "task_id long, periods array<string>")).first().missing == ["b"]
    assert evaluate.first_containing(tables, req).count() == 1


def test_plans(spark):
    tasks = spark.createDataFrame([(1, "t", "report", "g"), (2, "t", "report", "compare files"), (3, "t", "annual", "g")], "task_id long, task_name string, document_type string, goal string")
    rows = [(1, 0, "/a/x.pdf", "primary"), (2, 0, "/a/x.pdf", "primary"), (2, 1, "/a/scan.png", "audit"), (2, 2, None, "reference"), (3, 0, "/a/x.html", "primary")]
    inputs = spark.createDataFrame([(t, i, p, None if p else "http://u/v", r, None, "t", "report", 1.0) for t, i, p, r in rows], "task_id long, input_index int, path string, url string, role string, mime_type string, task_name string, document_type string, size_mb double")
    signals = routing.input_signals(inputs)
    profiles = routing.document_profiles(tasks, signals).join(tasks.select("task_id", "document_type"), "task_id")
    assert {r.task_id: (r.mixed_plan, r.parse_strategy) for r in profiles.collect()} == {1: (False, "text_first_with_quality_recovery"), 2: (True, "ocr_first"), 3: (False, "native_html_table_parse")}
    plan = steps.linear_plan(profiles).unionByName(steps.mixed_plan(profiles, signals)).cache()
    edges = steps.edges_of(plan)
    levels = steps.plan_levels(plan, edges, 40)
    s = {r.task_id: (r.step_count, r.edge_count, r.level_count, r.is_dag) for r in steps.graph_summary(plan, levels, edges).collect()}
    assert s[1] == (8, 7, 8, True) and s[2][3] and s[2][0] == 2 + 3 + 4 + 1 + 6
    bad = spark.createDataFrame([(9, "a", ["b"]), (9, "b", ["a"]), (9, "c", []), (9, "d", ["c", "ghost"]), (9, "e", ["d"])], "task_id long, name string, depends_on array<string>")
    assert [(r["name"], r.level) for r in steps.plan_levels(bad, steps.edges_of(bad), 20).collect()] == [("c", 0)]


def test_recovery_rules(spark):
    base = spark.createDataFrame([(1, 1, "high", 3, 0.5, 1.0), (2, 0, "low", 3, 1.0, 1.0), (3, 0, "high", 0, 1.0, 1.0)], "task_id long, failed_count int, risk_level string, table_count int, numeric_parse_coverage double, evidence_coverage double")
    cand = spark.createDataFrame([(1, 1, 1, "high", 3, 0.51, 1.0), (1, 2, 0, "medium", 3, 0.9, 1.0), (1, 3, 0, "low", 3, 1.0, 1.0), (2, 1, 0, "low", 3, 1.0, 1.0)], "task_id long, attempt int, failed_count int, risk_level string, table_count int, numeric_parse_coverage double, evidence_coverage double")
    assert {r.task_id: r.attempt for r in routing.recover(base, cand).collect()} == {1: 2, 2: None, 3: None}
    d = spark.createDataFrame([(1, 0, 3, 5, 0.5, 1.0), (1, 1, 9, 9, 1.0, 1.0), (2, 0, 0, 40, 0.1, 1.0)], "task_id long, table_seq long, page_start int, page_end int, numeric_parse_coverage double, evidence_coverage double")
    checks = spark.createDataFrame([(1, 1, "fail")], "task_id long, table_seq long, status string")
    pages = routing.attention_pages(d, checks)
    assert sorted(map(tuple, pages.collect())) == [(1, 3), (1, 4), (1, 5), (1, 9), (2, 0), (2, 40)]
    assert [tuple(r) for r in routing.targeted_window(pages).collect()] == [(1, 3, 9, [3, 4, 5, 9])]
    assert pages.limit(1).select(routing.target_pages(F.array(F.lit("3"), F.lit("x"), F.lit(" 1"), F.lit("3"))).alias("p")).first().p == [1, 3]


def test_inbox(spark, tmp_path):
    from tablewright.streaming.inbox import process_inbox

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(PAGES))
    process_inbox(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out" / "tables")).count() == 3


def test_levels_without_bounds(spark):
    """A chain deeper than 100, many diamonds, and more steps than the row limit of a recursive query."""
    chain = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(104)]
    wide = [(2, "root", [])] + [(2, f"w{i}", ["root"]) for i in range(300)]
    diamonds = [(3, "d0", [])] + [s for i in range(12) for s in ((3, f"l{i}", [f"d{i}"]), (3, f"r{i}", [f"d{i}"]), (3, f"d{i + 1}", [f"l{i}", f"r{i}"]))]
    plan = spark.createDataFrame(chain + wide + diamonds, "task_id long, name string, depends_on array<string>")
    edges = steps.edges_of(plan)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        levels = steps.plan_levels(plan, edges)
        got = {(r.task_id, r["name"]): r.level for r in levels.collect()}
        summary = {r.task_id: (r.step_count, r.edge_count, r.level_count, r.is_dag) for r in steps.graph_summary(plan, levels, edges).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(1, f"c{i}"): i for i in range(104)} | {(2, "root"): 0} | {(2, f"w{i}"): 1 for i in range(300)} | {(3, f"d{i}"): 2 * i for i in range(13)} | {(3, f"{x}{i}"): 2 * i + 1 for i in range(12) for x in "lr"}
    assert summary == {1: (104, 103, 104, True), 2: (301, 300, 2, True), 3: (37, 48, 25, True)}


def test_queries_without_the_corpus_operators(monkeypatch):
    """A library that the corpus operators need is missing: the other queries stay."""
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tablewright.llm", None)
    monkeypatch.setitem(sys.modules, "tablewright.llm.registry", None)
    found = __spark_entry__.queries()
    assert "task_pipeline" in found and not [n for n in found if n[:3].strip("op0123456789_") == "" or n == "pipeline"]
    assert set(__spark_entry__.oracle_sql()) <= set(found)
