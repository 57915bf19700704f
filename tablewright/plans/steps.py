"""Workflow plans as data: steps, their dependencies, and levels that may run side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import input_slug
from ..session import checkpointed

# Name, tool, names depended on.
HEAD = [("profile_inputs", "document_profiler", []), ("ingest", "file_loader", ["profile_inputs"])]
TAIL = [("recover_low_quality", "recovery_policy", ["verify_numbers"]), ("repair_low_confidence", "numeric_repair", ["recover_low_quality"]), ("package_result", "result_packager", ["repair_low_confidence"])]
CONTEXT = [("reconcile_cross_file_metrics", "cross_document_reconciler", ["infer_shared_financial_context"]), ("verify_numbers", "financial_verifier", ["reconcile_cross_file_metrics"])]
OFFICE_PACKS = ["office_attachment_pack", "ppt_xlsx_attachment_pack"]
# End of fixed values.
STEP = "struct<name:string,tool:string,depends_on:array<string>>"


def _step(name, tool, depends) -> F.Column:
    name = F.lit(name) if isinstance(name, str) else name
    tool = F.lit(tool) if isinstance(tool, str) else tool
    depends = F.array(*[F.lit(d) for d in depends]).cast("array<string>") if isinstance(depends, list) else depends
    return F.struct(name.alias("name"), tool.alias("tool"), depends.alias("depends_on")).cast(STEP)


def linear_plan(profiles: DataFrame) -> DataFrame:
    """task_id, step_seq, name, tool, depends_on of single-document tasks; ``profiles`` also has document_type."""
    office = F.col("has_office") | F.col("document_type").isin(*OFFICE_PACKS)
    scan = F.col("scanned_hint") | F.col("has_image")
    before = F.array_compact(F.array(F.when(office, "expand_office_attachments"), F.when(scan, "assess_scan_quality")))
    tool = F.when(F.col("has_html") & ~F.col("has_pdf") & ~F.col("has_image"), "native_html_parser").otherwise("document_parser")
    steps = F.array_compact(F.array(
        *[_step(*s) for s in HEAD],
        F.when(office, _step("expand_office_attachments", "office_unpacker", ["ingest"])),
        F.when(scan, _step("assess_scan_quality", "image_quality_checker", ["ingest"])),
        _step("parse_document", tool, F.when(F.size(before) > 0, before).otherwise(F.array(F.lit("ingest")))),
        _step("structure_financial_tables", "table_structure_builder", ["parse_document"]),
        _step("verify_numbers", "financial_verifier", ["structure_financial_tables"]),
        *[_step(*s) for s in TAIL],
    ))
    return profiles.where("not mixed_plan").select("task_id", F.posexplode(steps).alias("step_seq", "s")).select("task_id", "step_seq", "s.*")


def mixed_plan(profiles: DataFrame, signals: DataFrame) -> DataFrame:
    """The same of tasks with several documents: steps for each input, then a shared tail."""
    tasks = profiles.where("mixed_plan").select("task_id")
    slug = input_slug(F.col("input_index").cast("int"), F.col("path"), F.col("url"), F.col("role"))
    remote = F.coalesce("path", F.lit("")) == ""
    name = lambda head: F.concat(F.lit(head), slug)
    scan = F.col("scanned_hint") | F.col("image_like")
    tool = F.when(F.col("office_like") & ~F.col("pdf_like"), "native_office_or_parser").when(F.col("html_like"), "native_html_parser").when(scan, "document_parser_ocr").otherwise("document_parser")
    needs = F.array_compact(F.array(name("classify_"), F.when(F.col("office_like"), name("expand_")), F.when(scan, name("assess_scan_"))))
    local = F.array_compact(F.array(
        _step(name("classify_"), "input_profiler", ["ingest"]),
        F.when(F.col("office_like"), _step(name("expand_"), "office_unpacker", F.array(name("classify_")))),
        F.when(scan, _step(name("assess_scan_"), "image_quality_checker", F.array(name("classify_")))),
        _step(name("parse_"), tool, needs),
        _step(name("structure_"), "table_structure_builder", F.array(name("parse_"))),
    ))
    link = F.array(_step(F.format_string("record_remote_reference_%02d", F.col("input_index").cast("int")), "reference_registry", ["ingest"]))
    own = signals.join(tasks, "task_id", "left_semi")
    per_input = own.select("task_id", F.col("input_index").cast("int").alias("part"), F.posexplode(F.when(remote, link).otherwise(local)).alias("pos", "s"))
    structured = own.where(~remote).groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("input_index", name("structure_").alias("n")))), lambda x: x["n"]).alias("d"))
    head = tasks.select("task_id", F.lit(-1).alias("part"), F.posexplode(F.array(*[_step(*s) for s in HEAD])).alias("pos", "s"))
    tail_steps = F.array(_step("infer_shared_financial_context", "context_inferencer", F.col("d")), *[_step(*s) for s in CONTEXT], *[_step(n, "contextual_numeric_repair" if n == "repair_low_confidence" else t, d) for n, t, d in TAIL])
    tail = structured.select("task_id", F.lit(1 << 30).alias("part"), F.posexplode(tail_steps).alias("pos", "s"))
    from pyspark.sql import Window

    every = head.union(per_input).union(tail)
    seq = F.row_number().over(Window.partitionBy("task_id").orderBy("part", "pos")) - 1
    return every.select("task_id", seq.alias("step_seq"), "s.*")


def edges_of(steps: DataFrame) -> DataFrame:
    """task_id, source, target of each dependency."""
    return steps.select("task_id", F.explode("depends_on").alias("source"), F.col("name").alias("target"))


def plan_levels(steps: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """task_id, name, level: 0 without dependencies, else one more than the latest of them.

    A step of a cycle, behind one, or behind an unknown step has no level. Each round takes the steps
    whose sources all have levels, until there are none; with ``most``, levels below ``most`` - 1 only.
    """
    step = ["task_id", "name"]
    edges = checkpointed(edges)
    waiting = checkpointed(edges.groupBy("task_id", F.col("target").alias("name")).agg(F.count("*").alias("n")))
    ready = checkpointed(steps.select(step).distinct().join(waiting, step, "left_anti"))
    done, recent, level = [ready.limit(0).withColumn("level", F.lit(0))], [], 0
    while (most is None or level < most - 1) and ready.limit(1).count():
        recent.append(ready.withColumn("level", F.lit(level)))
        if len(recent) == 32:  # a short plan, however many levels
            done, recent = [checkpointed(_union(done + recent))], []
        met = edges.join(ready.withColumnRenamed("name", "source"), ["task_id", "source"]).groupBy("task_id", F.col("target").alias("name")).agg(F.count("*").alias("met"))
        left = checkpointed(waiting.join(met, step, "left").select(*step, (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")))
        ready, waiting, level = left.where("n = 0").select(step), left.where("n > 0"), level + 1
    return _union(done + recent)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def graph_summary(steps: DataFrame, levels: DataFrame, edges: DataFrame) -> DataFrame:
    """task_id, step_count, edge_count, level_count, is_dag."""
    n = steps.groupBy("task_id").agg(F.count("*").alias("step_count"))
    e = edges.groupBy("task_id").agg(F.count("*").alias("edge_count"))
    v = levels.groupBy("task_id").agg((F.max("level") + 1).alias("level_count"), F.count("*").alias("visited"))
    return n.join(e, "task_id", "left").join(v, "task_id", "left").fillna(0).select("task_id", "step_count", "edge_count", "level_count", (F.col("visited") == F.col("step_count")).alias("is_dag"))
