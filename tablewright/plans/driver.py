"""Whole tasks: profile, plan, parse, structure, context, verify, recover, repair, package, for many tasks at once.

A document parser runs outside. What its attempts said and left behind comes in as tables, and the
driver decides which attempt counts. Each stage is a DataFrame over all tasks; tasks that failed drop out of the stages.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.reconcile import conflict_report, reconcile, role_counts, shared_context
from ..operators.repair import repair_cells, repair_log
from ..operators.structure import Tables, materialize_tables
from ..session import checkpointed
from ..sources import artifacts, html
from . import routing, steps

# Fixed values.
MESSAGES = {"no_input": "No local input paths were supplied.", "html": "Native HTML parsing failed.", "parse": "Parsing failed after recovery attempts."}
READERS = {"v2": artifacts.flatten_v2, "legacy": artifacts.flatten_legacy, "middle": artifacts.flatten_middle}
# End of fixed values.


@dataclass
class Run:
    """What a run of tasks leaves: a DataFrame for each kind of output."""

    plan: DataFrame
    attempts: DataFrame
    status: DataFrame
    blocks: DataFrame
    tables: Tables
    context: DataFrame
    conflicts: DataFrame
    quality: DataFrame
    accepted: DataFrame
    repairs: DataFrame
    results: DataFrame
    trace: DataFrame

    @cached_property
    def levels(self) -> DataFrame:
        """The levels of the plan's steps, which nothing in a run depends on."""
        return steps.plan_levels(self.plan, steps.edges_of(self.plan))


def plan_tasks(tasks: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals of the inputs, profiles of the tasks, and the steps of their plans, linear or mixed."""
    signals = routing.input_signals(inputs.join(tasks.select("task_id", "task_name", "document_type"), "task_id"))
    profiles = routing.document_profiles(tasks, signals).join(tasks.select("task_id", "document_type"), "task_id")
    return signals, profiles, steps.linear_plan(profiles).unionByName(steps.mixed_plan(profiles, signals))


def choose_attempts(signals: DataFrame, tasks: DataFrame, documents: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log of attempts with their outcome, and the first that succeeded of each input that can be parsed.

    An HTML input succeeds if its page is in ``documents``; other inputs by what ``runs`` says. Nothing after a
    terminal failure counts.
    """
    options = ["option_backend", "option_method", "server_url", "auto_recovery"]
    based = routing.base_options(routing.select_parse_inputs(signals).join(tasks.select("task_id", *options), "task_id"))
    tries = routing.attempts(based).join(based.select("task_id", "input_index", "html_like", "path"), ["task_id", "input_index"])
    key = ["task_id", "input_index", "attempt"]
    page = documents.where("kind = 'html'").select(*key, F.lit(True).alias("page")).distinct()
    logged = tries.join(runs, key, "left").join(page, key, "left")
    status = F.when(F.col("html_like"), F.when(F.col("page"), "succeeded").otherwise("missing_input")).otherwise(F.col("status"))
    failure = F.when(F.coalesce(status, F.lit("succeeded")) != "succeeded", routing.classify_failure(status, F.col("message"), F.col("stdout"), F.col("stderr"), F.col("returncode")))
    log = logged.withColumn("status", status).withColumn("failure", failure).withColumn("folder", routing.attempt_folder(F.col("input_index"), F.col("path"), F.col("attempt"), F.col("reason")))
    log = checkpointed(log.select(*key, "backend", "method", "server_url", "reason", "folder", "html_like", "status", "failure"))
    ended = F.min(F.when(F.coalesce("failure.terminal", F.lit(False)), F.col("attempt")))
    first = F.min(F.when(F.col("status") == "succeeded", F.col("attempt")))
    chosen = log.groupBy("task_id", "input_index", "html_like").agg(first.alias("first"), ended.alias("ended"))
    good = F.col("first").isNotNull() & (F.col("ended").isNull() | (F.col("first") < F.col("ended")))
    return log, chosen.select("task_id", "input_index", "html_like", F.when(good, F.col("first")).alias("attempt"))


def task_status(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """task_id, status, message: a task fails without inputs to parse, or if one of them couldn't be."""
    g = chosen.groupBy("task_id").agg(F.bool_or(F.col("attempt").isNull()).alias("bad"), F.bool_or(F.col("attempt").isNull() & F.col("html_like")).alias("bad_html"))
    both = tasks.select("task_id").join(g, "task_id", "left")
    message = F.when(F.col("bad").isNull(), MESSAGES["no_input"]).when(F.col("bad_html"), MESSAGES["html"]).when(F.col("bad"), MESSAGES["parse"])
    return both.select("task_id", F.when(F.coalesce("bad", F.lit(True)), "failed").otherwise("succeeded").alias("status"), message.alias("message"))


def document_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents (task_id, kind, body): HTML pages, or artifacts, the first kind that has any."""
    json = documents.select("task_id", "kind", F.col("body").alias("json"))
    listed = artifacts.prefer_blocks(*[read(json.where(F.col("kind") == k)) for k, read in READERS.items()])
    return listed.unionByName(html.html_blocks(documents.where("kind = 'html'"), html="body"))


def task_blocks(documents: DataFrame, chosen: DataFrame, inputs: DataFrame) -> DataFrame:
    """The blocks of each task's inputs one after another, each with its input and role."""
    part = ["task_id", "input_index"]
    held = documents.join(chosen.where("attempt is not null").select(*part, "attempt"), [*part, "attempt"], "left_semi")
    each = document_blocks(held.select(F.struct(*part).alias("task_id"), "kind", "body"))
    own = each.select("task_id.*", *[c for c in each.columns if c != "task_id"]).join(inputs.select(*part, "role"), part)
    order = Window.partitionBy("task_id").orderBy("input_index", "block_seq")
    return own.withColumn("block_seq", F.row_number().over(order).cast("long") - 1)


def judged(tasks: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diagnostics, checks and the quality record."""
    d, c = Q.table_diagnostics(t.tables, t.rows, t.cells), Q.verify(t.tables, t.rows, t.cells)
    return d, c, Q.quality(tasks, d, c)


def contextual(plan: DataFrame, blocks: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """Shared context and the report on conflicts between files, of tasks whose plan has these steps."""
    semi = lambda d, name: d.join(routing.find_step(plan, name).select("task_id").distinct(), "task_id", "left_semi")
    name = "infer_shared_financial_context"
    roles = role_counts(semi(blocks, name)).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("role", "n"))).alias("source_roles"))
    context = shared_context(semi(t.tables, name), semi(t.rows, name), semi(t.cells, name)).join(roles, "task_id", "left")
    row = ["task_id", "table_seq", "row_seq"]
    records = t.cells.join(t.rows.select(*row, F.col("item").alias("metric")), row).join(t.tables.select("task_id", "table_seq", "role"), ["task_id", "table_seq"]).where("value is not null")
    records = semi(records, "reconcile_cross_file_metrics").select("task_id", "metric", "period", "value", "role")
    found = reconcile(records)
    none = F.array().cast(dict(conflict_report(found, records).dtypes)["conflicts"])
    report = semi(plan.select("task_id").distinct(), "reconcile_cross_file_metrics").join(conflict_report(found, records), "task_id", "left")
    return context, report.fillna(0, ["matched_metric_count", "conflict_count"]).fillna(False, ["truncated"]).withColumn("conflicts", F.coalesce("conflicts", none))


def recovered(t: Tables, quality: DataFrame, chosen: DataFrame, retries: DataFrame) -> tuple[Tables, DataFrame]:
    """Tables with the first retry that improves a poor task's quality in place, and what was taken (task_id, attempt).

    ``retries`` has task_id, attempt, kind, body, target_pages; only tasks with one parsed input take part.
    A retry of target pages replaces the tables on them, any other all of them.
    """
    single = chosen.groupBy("task_id").agg(F.count("*").alias("n")).where("n = 1").select("task_id")
    poor = quality.where(routing.should_retry()).select("task_id").join(single, "task_id", "left_semi")
    tried = checkpointed(retries.join(poor, "task_id", "left_semi").withColumn("key", F.struct("task_id", "attempt")))
    fresh = materialize_tables(document_blocks(tried.select(F.col("key").alias("task_id"), "kind", "body")))
    keys = tried.select(F.col("key").alias("task_id"), F.col("task_id").alias("of"), F.coalesce("target_pages", F.array().cast("array<int>")).alias("pages")).distinct()
    aimed = keys.where("size(pages) > 0")
    spread = lambda d: d.withColumnRenamed("task_id", "of").join(aimed.select("task_id", "of"), "of").drop("of")
    merged = routing.merge_targeted_tables(Tables(spread(t.tables), spread(t.rows), spread(t.cells)), fresh, aimed.select("task_id", F.explode("pages").alias("page")))
    merged = Tables(*[checkpointed(d) for d in (merged.tables, merged.rows, merged.cells)])
    _, _, q = judged(keys.select("task_id"), merged)
    graded = q.select("task_id.*", *[c for c in q.columns if c != "task_id"])
    taken = checkpointed(routing.recover(quality.join(poor, "task_id", "left_semi"), graded).where("attempt is not null"))
    new = taken.select(F.struct("task_id", "attempt").alias("task_id"))
    kept = [d.join(taken.select("task_id"), "task_id", "left_anti") for d in (t.tables, t.rows, t.cells)]
    put = [d.join(new, "task_id", "left_semi").withColumn("task_id", F.col("task_id.task_id")) for d in (merged.tables, merged.rows, merged.cells)]
    return Tables(*[a.unionByName(b, allowMissingColumns=True) for a, b in zip(kept, put, strict=True)]), taken


def packaged(tasks: DataFrame, status: DataFrame, t: Tables, quality: DataFrame, log: DataFrame) -> DataFrame:
    """A result for each task: status, summary, tables with their rows and cells, quality; a failed task has its message alone."""
    row, table = ["task_id", "table_seq", "row_seq"], ["task_id", "table_seq"]
    listed = lambda d, by, name, *columns: d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    cells = listed(t.cells, row, "cells", "cell_index", "period", "raw", "value")
    rows = listed(t.rows.join(cells, row, "left"), table, "rows", "row_seq", "item", "row_type", "components", "page", "bbox", "cells")
    tables = listed(t.tables.join(rows, table, "left"), ["task_id"], "tables", "table_seq", "name", "title", "unit", "periods", "page_start", "page_end", "rows")
    record = quality.join(log, "task_id", "left").select("task_id", F.struct(*[c for c in quality.columns if c != "task_id"], F.struct(F.coalesce("repair_count", F.lit(0)).alias("repair_count"), "repairs", F.coalesce("truncated", F.lit(False)).alias("truncated")).alias("repairs")).alias("quality"))
    told = Q.summary(quality, log)
    each = tasks.select("task_id", "task_name", "document_type").join(status, "task_id").join(told, "task_id", "left").join(tables, "task_id", "left").join(record, "task_id", "left")
    return each.select("task_id", "task_name", "status", "document_type", F.coalesce("message", "summary").alias("summary"), "tables", "quality")


def run_tasks(tasks: DataFrame, inputs: DataFrame, documents: DataFrame, runs: DataFrame, retries: DataFrame | None = None, parity: bool = False) -> Run:
    """Run tasks (task_id, task_name, document_type, goal, option_backend, option_method, server_url, auto_recovery).

    ``inputs``: task_id, input_index, path, url, role, mime_type, size_mb. ``documents``: task_id, input_index,
    attempt, kind (html, v2, legacy, middle), body. ``runs``: task_id, input_index, attempt, status,
    message, stdout, stderr, returncode of the parser. ``retries``: see :func:`recovered`.
    """
    signals, profiles, plan = plan_tasks(tasks, inputs)
    plan, signals = checkpointed(plan), checkpointed(signals)
    log, chosen = choose_attempts(signals, tasks, documents, runs)
    chosen = checkpointed(chosen)
    status = checkpointed(task_status(tasks, chosen))
    alive = status.where("status = 'succeeded'").select("task_id")
    blocks = checkpointed(task_blocks(documents, chosen.join(alive, "task_id", "left_semi"), inputs))
    found = materialize_tables(blocks, parity)
    t = Tables(*[checkpointed(d) for d in (found.tables, found.rows, found.cells)])
    context, conflicts = contextual(plan, blocks, t)
    quality, accepted = checkpointed(judged(alive, t)[2]), alive.select("task_id", F.lit(None).cast("int").alias("attempt")).limit(0)
    if retries is not None:
        t, accepted = recovered(t, quality, chosen.join(alive, "task_id", "left_semi"), retries)
        t = Tables(*[checkpointed(d) for d in (t.tables, t.rows, t.cells)])
    cells, repairs = repair_cells(t.tables, t.rows, t.cells)
    t, repairs = replace(t, cells=checkpointed(cells)), checkpointed(repairs)
    quality = checkpointed(Q.attach_context(judged(alive, t)[2], context, conflicts))
    logged = repair_log(repairs)
    results = packaged(tasks, status, t, quality, logged)
    return Run(plan, log, status, blocks, t, context, conflicts, quality, accepted, repairs, results, trace_of(plan, log, status, quality))


def trace_of(plan: DataFrame, log: DataFrame, status: DataFrame, quality: DataFrame) -> DataFrame:
    """task_id, seq, stage, event_type, status, tool, outputs (JSON): the plan's steps with what is known of each."""
    parses = log.where("status is not null").groupBy("task_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("input_index", "attempt", "backend", "method", "status")))).alias("attempts"))
    told = Q.quality_summary(quality)
    told = told.select("task_id", F.to_json(F.struct(*[c for c in told.columns if c != "task_id"])).alias("quality"))
    every = plan.join(status, "task_id").join(parses, "task_id", "left").join(told, "task_id", "left")
    parse, verify = F.col("name").startswith("parse_"), F.col("name") == "verify_numbers"
    done = F.when(F.col("status") == "failed", F.when(parse, "failed").when(F.col("name").isin("profile_inputs", "ingest"), "succeeded").otherwise("skipped")).otherwise("succeeded")
    return every.select("task_id", F.col("step_seq").alias("seq"), F.col("name").alias("stage"), F.lit("step_finished").alias("event_type"), done.alias("status"), "tool", F.when(parse, F.col("attempts")).when(verify, F.col("quality")).alias("outputs"))
