"""The whole-task driver on literal tasks: several inputs, failures, recovery, repair, stores."""

import json

import pytest

from tablewright.plans import driver
from tablewright.sources import artifacts, stores

PAGE = "<title>Filing</title><p>Unit: USD</p><table><caption>Assets</caption><tr><th>Item</th><th>FY25</th></tr><tr><td>Cash</td><td>{}</td></tr></table>"


def artifact(*rows, title="Assets", page=0):
    block = {"type": "table", "page_idx": page, "content": {"title": title, "unit": "USD", "periods": ["FY25"], "rows": [{"label": a, "values": [b], "components": c} for a, b, c in rows]}}
    return json.dumps([[block]])


@pytest.fixture(scope="module")
def run(spark):
    options = (None, None, None, True)
    tasks = [(i, f"task {i}", "report", "compare files" if i == 1 else "extract", *options) for i in range(1, 7)]
    inputs = [(1, 0, "/a/one.html", None, "primary"), (1, 1, "/a/two.pdf", None, "attachment"), (2, 0, "/a/bad.pdf", None, "primary"), (3, 0, None, "http://u/v", "primary"), (4, 0, "/a/poor.pdf", None, "primary"), (5, 0, "/a/sum.pdf", None, "primary"), (6, 0, "/a/lost.html", None, "primary")]
    good, poor, empty = artifact(("Cash", "150", [])), artifact(("A", "1", []), ("Total", "5", ["A"])), json.dumps([[{"type": "text", "text": "nothing here"}]])
    documents = [(1, 0, 0, "html", PAGE.format("1OO")), (1, 1, 1, "v2", good), (4, 0, 0, "v2", empty), (5, 0, 0, "v2", poor)]
    runs = [(1, 1, 0, "failed", "request timed out", 1), (1, 1, 1, "succeeded", None, 0), (2, 0, 0, "failed", "bad flag", 2), (2, 0, 1, "failed", "CUDA out of memory", 1), (4, 0, 0, "succeeded", None, 0), (5, 0, 0, "succeeded", None, 0)]
    fixed = artifact(("A", "5", []), ("Total", "5", ["A"]))
    retries = [(4, 1, "v2", empty, None), (4, 2, "v2", artifact(("Cash", "7", [])), None), (5, 1, "v2", poor, [0]), (5, 2, "v2", fixed, [0]), (1, 1, "v2", good, None)]
    return driver.run_tasks(
        spark.createDataFrame(tasks, "task_id long, task_name string, document_type string, goal string, option_backend string, option_method string, server_url string, auto_recovery boolean"),
        spark.createDataFrame([(*r, None, 1.0) for r in inputs], "task_id long, input_index int, path string, url string, role string, mime_type string, size_mb double"),
        spark.createDataFrame(documents, "task_id long, input_index int, attempt int, kind string, body string"),
        spark.createDataFrame([(t, i, a, s, m, None, None, c) for t, i, a, s, m, c in runs], "task_id long, input_index int, attempt int, status string, message string, stdout string, stderr string, returncode int"),
        spark.createDataFrame(retries, "task_id long, attempt int, kind string, body string, target_pages array<int>"),
    )


def test_results(run):
    r = {x.task_id: x for x in run.results.collect()}
    assert {i: x.status for i, x in r.items()} == {1: "succeeded", 2: "failed", 3: "failed", 4: "succeeded", 5: "succeeded", 6: "failed"}
    assert (r[2].summary, r[3].summary, r[6].summary) == (driver.MESSAGES["parse"], driver.MESSAGES["no_input"], driver.MESSAGES["html"])
    assert r[1].quality.repairs.repair_count == 1 and r[1].summary.endswith("repairs: 1.")
    assert sorted(t.rows[0].cells[0].value for t in r[1].tables) == [100.0, 150.0]
    report = r[1].quality.cross_file_checks
    assert (report.matched_metric_count, report.conflict_count, report.truncated) == (0, 0, False)  # the damaged cell is read only later
    assert r[4].quality.cross_file_checks is None and [x.role for x in r[1].quality.shared_context.source_roles] == ["attachment", "primary"]


def test_recovery(run):
    """The first retry that improves: more tables for task 4, no failed sum for task 5; several inputs take no part."""
    assert {x.task_id: x.attempt for x in run.accepted.collect()} == {4: 2, 5: 2}
    q = {x.task_id: x for x in run.quality.collect()}
    assert (q[4].row_count, q[5].failed_count, q[5].table_count, q[5].risk_level) == (1, 0, 1, "low")


def test_attempts_plan_and_trace(run):
    log = {(x.task_id, x.input_index, x.attempt): x for x in run.attempts.collect()}
    assert log[1, 1, 0].failure.category == "timeout" and log[1, 1, 1].folder == "1_two_retry_with_ocr" and log[2, 0, 1].failure.category == "resource_exhausted"
    levels = {(x.task_id, x["name"]): x.level for x in run.levels.collect()}
    assert levels[1, "infer_shared_financial_context"] > levels[1, "parse_input_01_two"] and levels[2, "package_result"] == 7
    trace = {(x.task_id, x.stage): x for x in run.trace.collect()}
    assert trace[2, "parse_document"].status == "failed" and trace[2, "verify_numbers"].status == "skipped" and json.loads(trace[5, "verify_numbers"].outputs)["failed_count"] == 0


def test_saved(spark, run, tmp_path):
    stores.save_run(run, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/plans").where("task_id = 1").first().steps[0]["name"] == "profile_inputs"
    assert artifacts.filter_trace(spark.read.json(f"{tmp_path}/trace"), ["package_result"]).count() >= 4
    assert spark.read.json(f"{tmp_path}/results").count() == 6
    v = spark.createDataFrame([(1, 1, "queued"), (2, 1, "queued")], "task_id long, updated_at int, status string")
    stores.save_tasks(v, f"{tmp_path}/tasks")
    stores.save_tasks(v.limit(1).selectExpr("task_id", "2 AS updated_at", "'done' AS status"), f"{tmp_path}/tasks")
    assert sorted((x.task_id, x.status) for x in stores.load_tasks(spark, f"{tmp_path}/tasks").collect()) == [(1, "done"), (2, "queued")]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a_middle.json").write_text("{}")
    assert artifacts.discover_artifacts(spark, str(tmp_path / "files")).first().kind == "middle"
    assert artifacts.read_json_artifacts(spark, str(tmp_path / "files")).first().json == "{}"
    assert artifacts.file_digests(spark, str(tmp_path / "files")).first().sha256.startswith("44136fa355b3678a")
