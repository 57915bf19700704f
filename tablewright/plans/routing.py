"""Routing rules as column expressions: input signals, document profiles, attempts and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PDF, HTML = [".pdf"], [".html", ".htm"]
IMAGE = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
OFFICE = [".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"]
CHINESE_HINTS = ["年报", "财务", "审计", "招行", "茅台", "宁德", "比亚迪", "资产", "利润", "现金流", "china", "cn_"]
SCAN_HINTS = ["scan", "scanned", "ocr", "photo", "image", "拍照", "扫描", "低质量"]
CROSS_FILE = ["核对", "核验", "reconcile", "compare", "cross-file", "附件"]
LARGE_MB, WINDOW_PAGES, LONG_SPAN = 25, 12, 20
REMOTE = ["vlm-http-client", "hybrid-http-client"]
PARSEABLE = [".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff"]
CLI_VALUES = [("method", "-m"), ("backend", "-b"), ("lang", "-l"), ("server_url", "-u"), ("start_page", "-s"), ("end_page", "-e")]
CLI_FLAGS = [("formula", "-f"), ("table", "-t"), ("image_analysis", "--image-analysis")]
REASONS = {
    "ocr_first": "Input metadata or file type indicates scanned/image content.",
    "native_html_table_parse": "HTML input can be parsed directly into table blocks without OCR.",
    "office_attachment_expansion": "Office inputs should be expanded and parsed as document units.",
    "sample_then_full_text": "Large or annual-report-like PDF should be profiled before full extraction.",
    "text_first_with_quality_recovery": "PDF appears suitable for text-layer parsing with OCR fallback.",
    "generic_document_parse": "No specialized route was inferred from inputs.",
    "chinese": "Chinese financial-report hints detected; prefer Chinese language settings when supplied.",
    "remote": "Remote input URL present; caller should mount or fetch it before local parsing.",
}
FAILURES = {
    "model_cache_unavailable": ["localentrynotfounderror", "cannot find the appropriate snapshot"],
    "model_config_missing": ["models_download_utils", "local_models_config"],
    "resource_exhausted": ["cuda out of memory", "outofmemoryerror", "resource exhausted"],
    "remote_backend_unavailable": ["connection refused", "failed to establish a new connection"],
    "timeout": ["timed out", "timeout"],
}
CONFIG_MISSING = "'nonetype' object has no attribute 'get'"
# End of fixed values.


def any_in(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def suffix(path: Column) -> Column:
    """The file name's last suffix in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def input_signals(inputs: DataFrame) -> DataFrame:
    """``inputs`` (task_id, input_index, path, url, role, mime_type, task_name, document_type, size_mb) with type flags and hints."""
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    name = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("path", "url", "mime_type", "role", "task_name", "document_type")]))
    s = F.coalesce(suffix(F.col("path")), F.lit(""))
    return inputs.withColumns({
        "suffix": s,
        "pdf_like": s.isin(*PDF) | F.contains(mime, F.lit("pdf")),
        "image_like": s.isin(*IMAGE) | mime.startswith("image/"),
        "office_like": s.isin(*OFFICE) | any_in(mime, OFFICE),
        "html_like": s.isin(*HTML) | F.contains(mime, F.lit("html")),
        "scanned_hint": any_in(name, SCAN_HINTS),
        "chinese_hint": any_in(name, CHINESE_HINTS),
    })


def document_profiles(tasks: DataFrame, signals: DataFrame) -> DataFrame:
    """A profile of each of ``tasks`` (task_id, task_name, document_type, goal): flags, strategy, method, backend, reasons."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    path = F.coalesce("path", F.lit("")) != ""
    g = signals.groupBy("task_id").agg(
        F.count("*").alias("input_count"), F.count_if(path).alias("local_input_count"), any_("pdf_like").alias("has_pdf"), any_("image_like").alias("has_image"), any_("office_like").alias("has_office"), any_("html_like").alias("has_html"),
        any_(~path & (F.coalesce("url", F.lit("")) != "")).alias("has_remote_input"), any_("scanned_hint").alias("scan"), any_("chinese_hint").alias("chinese"), any_(F.col("pdf_like") & (F.col("size_mb") >= LARGE_MB)).alias("large"), F.collect_set("role").alias("roles"),
    )
    flags = ["has_pdf", "has_image", "has_office", "has_html", "has_remote_input", "scan", "chinese", "large"]
    p = tasks.join(g, "task_id", "left").fillna(False, flags).fillna(0, ["input_count", "local_input_count"])
    said = F.lower(F.concat_ws(" ", "task_name", "document_type", "goal"))
    annual = F.contains(F.lower("document_type"), F.lit("annual")) | any_in(F.lower("task_name"), ["annual", "年报"])
    p = p.withColumns({"scanned_hint": any_in(said, SCAN_HINTS) | F.col("scan"), "chinese_hint": any_in(said, CHINESE_HINTS) | F.col("chinese"), "large_document_hint": F.when(annual, F.col("has_pdf")).otherwise(F.col("large"))})
    routes = [
        (F.col("scanned_hint") | F.col("has_image"), "ocr_first", "ocr", REASONS["ocr_first"]),
        (F.col("has_html") & ~F.col("has_pdf") & ~F.col("has_office"), "native_html_table_parse", "html_table", REASONS["native_html_table_parse"]),
        (F.col("has_office") & ~F.col("has_pdf"), "office_attachment_expansion", None, REASONS["office_attachment_expansion"]),
        (F.col("large_document_hint"), "sample_then_full_text", "txt", REASONS["sample_then_full_text"]),
        (F.col("has_pdf"), "text_first_with_quality_recovery", "txt", REASONS["text_first_with_quality_recovery"]),
    ]
    route = reduce(lambda rest, r: F.when(r[0], F.struct(F.lit(r[1]).alias("strategy"), F.lit(r[2]).cast("string").alias("method"), F.lit(r[3]).alias("reason"))).otherwise(rest), reversed(routes), F.struct(F.lit("generic_document_parse").alias("strategy"), F.lit(None).cast("string").alias("method"), F.lit(REASONS["generic_document_parse"]).alias("reason")))
    p = p.withColumn("route", route)
    reasons = F.array_compact(F.array(F.col("route.reason"), F.when(F.col("chinese_hint"), REASONS["chinese"]), F.when(F.col("has_remote_input"), REASONS["remote"])))
    modalities = sum(F.col(c).cast("int") for c in ("has_pdf", "has_image", "has_office", "has_html"))
    mixed = (F.col("local_input_count") >= 2) & (F.arrays_overlap(F.coalesce("roles", F.array().cast("array<string>")), F.array(F.lit("attachment"), F.lit("reference"))) | any_in(said, CROSS_FILE) | (modalities >= 2))
    backend = F.when(F.col("has_pdf") | F.col("has_image"), "pipeline").when(F.col("has_html"), "native_html").otherwise("native_or_parser")
    return p.select("task_id", "input_count", "local_input_count", "has_pdf", "has_image", "has_office", "has_html", "has_remote_input", "scanned_hint", "chinese_hint", "large_document_hint", backend.alias("recommended_backend"), F.col("route.method").alias("recommended_method"), F.col("route.strategy").alias("parse_strategy"), F.when(F.col("large_document_hint"), F.array(F.lit(0), F.lit(2))).alias("preflight_pages"), reasons.alias("reasons"), mixed.alias("mixed_plan"))


def select_primary(inputs: DataFrame) -> DataFrame:
    """Of each task the first input of role primary, else its first input."""
    order = Window.partitionBy("task_id").orderBy((F.col("role") != "primary").cast("int"), "input_index")
    return inputs.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def base_options(signals: DataFrame) -> DataFrame:
    """``signals`` with backend and method: an option that is set stays (option_backend, option_method)."""
    parseable = F.col("suffix").isin(*PARSEABLE)
    html = F.col("suffix").isin(*HTML)
    ocr = F.col("image_like") | F.col("scanned_hint") | F.contains(F.lower("document_type"), F.lit("scanned"))
    backend = F.coalesce("option_backend", F.when(html, "native_html").when(parseable, "pipeline"))
    method = F.coalesce("option_method", F.when(html, "html_table").when(parseable, F.when(ocr, "ocr").otherwise("txt")))
    return signals.withColumns({"backend": backend, "method": method})


def attempts(options: DataFrame) -> DataFrame:
    """A row for each parse attempt of (task_id, input_index, suffix, backend, method, server_url, auto_recovery): attempt, ..., reason.

    The base first, then OCR, the remote hybrid and the local pipeline where they apply; equal ones once.
    """
    backend, method = F.lower(F.coalesce("backend", F.lit(""))), F.lower(F.coalesce("method", F.lit("")))
    remote = backend.isin(*REMOTE)
    open_ = F.coalesce("auto_recovery", F.lit(True)) & F.col("suffix").isin(*PARSEABLE)
    make = lambda b, m, s, r: F.struct(b.alias("backend"), m.alias("method"), s.alias("server_url"), F.lit(r).cast("string").alias("reason"))
    b, m, s, none = F.col("backend"), F.col("method"), F.col("server_url"), F.lit(None).cast("string")
    every = F.array(
        make(b, m, s, None),
        F.when(open_ & backend.isin("", "pipeline") & (method != "ocr"), make(F.lit("pipeline"), F.lit("ocr"), s, "retry_with_ocr")),
        F.when(open_ & ~remote & (F.coalesce(s, F.lit("")) != ""), make(F.lit("hybrid-http-client"), m, s, "retry_with_remote_hybrid")),
        F.when(open_ & remote, make(F.lit("pipeline"), F.coalesce(m, F.lit("txt")), none, "retry_with_local_pipeline")),
    )
    return options.select("task_id", "input_index", F.posexplode(F.array_distinct(F.array_compact(every))).alias("attempt", "o")).select("task_id", "input_index", "attempt", "o.*")


def dedupe_options(options: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first of equal option rows of a task, by the options as text."""
    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]))
    rank = F.row_number().over(Window.partitionBy("task_id", key).orderBy(order))
    return options.withColumn("rank", rank).where("rank = 1").drop("rank")


def needs_preflight(options: DataFrame) -> Column:
    """May a sample of the first pages decide the route? Large PDFs read as text, without a page window of their own."""
    return F.coalesce("preflight", F.lit(True)) & F.col("start_page").isNull() & F.col("end_page").isNull() & (F.col("suffix") == ".pdf") & F.col("large_document_hint") & (F.lower(F.coalesce("method", F.lit(""))) == "txt")


def should_retry(q: DataFrame | None = None) -> Column:
    """Is a quality record poor enough for another parse?"""
    return (F.col("failed_count") > 0) | (F.col("risk_level") == "high") | (F.col("table_count") == 0) | (F.col("numeric_parse_coverage") < 0.85) | (F.col("evidence_coverage") < 0.8)


def improved(old: str, new: str) -> Column:
    """Is quality record ``new`` (a table alias) better than ``old``: fewer failures, less risk, tables at last, or 0.03 more numbers with evidence no worse?"""
    from ..functions.text import risk_rank

    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    numbers = (n("numeric_parse_coverage") >= o("numeric_parse_coverage") + 0.03) & (n("evidence_coverage") >= o("evidence_coverage"))
    return (n("failed_count") < o("failed_count")) | (risk_rank(n("risk_level")) < risk_rank(o("risk_level"))) | ((o("table_count") == 0) & (n("table_count") > 0)) | numbers


def recover(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """task_id, attempt of the first candidate quality that improves the base, for tasks that should retry; null without one."""
    b, c = base.where(should_retry()).alias("b"), candidates.alias("c")
    better = b.join(c, F.col("b.task_id") == F.col("c.task_id")).where(improved("b", "c")).groupBy(F.col("b.task_id").alias("task_id")).agg(F.min("c.attempt").alias("attempt"))
    return base.select("task_id").join(better, "task_id", "left")


def page_range(start: Column, end: Column) -> Column:
    """Pages from start to end in either order; the two ends alone of a span over 20; null pages give none."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(lo.isNull(), F.array().cast("array<int>")).when(hi - lo > LONG_SPAN, F.array(lo, hi)).otherwise(F.sequence(lo, hi))


def attention_pages(diagnostics: DataFrame, checks: DataFrame) -> DataFrame:
    """task_id, page of tables that fail a check or have low numeric or evidence coverage."""
    failed = checks.where("status = 'fail'").select("task_id", "table_seq", F.lit(True).alias("failed")).distinct()
    d = diagnostics.join(failed, ["task_id", "table_seq"], "left").where("coalesce(failed, false) or numeric_parse_coverage < 0.95 or evidence_coverage < 0.9")
    return d.select("task_id", F.explode(page_range(F.col("page_start"), F.col("page_end"))).alias("page")).distinct()


def targeted_window(pages: DataFrame) -> DataFrame:
    """task_id, start_page, end_page, target_pages of an OCR retry, where the pages lie at most 12 apart."""
    g = pages.groupBy("task_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.array_sort(F.collect_set("page")).alias("target_pages"))
    return g.where(F.col("end_page") - F.col("start_page") <= WINDOW_PAGES)


def target_pages(values: Column) -> Column:
    """Whole numbers of a list of options, others left out, each once in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(values, lambda v: F.trim(v).try_cast("int")))))


def table_pages(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """task_id, table_seq, pages: the table's page range, or the pages of its rows if it has none."""
    of_rows = rows.groupBy("task_id", "table_seq").agg(F.array_sort(F.collect_set("page")).alias("row_pages"))
    own = page_range(F.col("page_start"), F.col("page_end"))
    held = tables.select("task_id", "table_seq", own.alias("own")).join(of_rows, ["task_id", "table_seq"], "left")
    return held.select("task_id", "table_seq", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("row_pages", F.col("own"))).alias("pages"))


def overlapping(original: DataFrame, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """task_id, table_seq of the originals (with pages) on the target pages (task_id, page) of tasks that have candidates."""
    tried = candidates.select("task_id").distinct()
    return original.select("task_id", "table_seq", F.explode("pages").alias("page")).join(targets.join(tried, "task_id", "left_semi"), ["task_id", "page"], "left_semi").select("task_id", "table_seq").distinct()


def merge_targeted(original: DataFrame, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Tables of a retry in place of the originals on its pages; tasks without candidates keep their originals.

    ``original`` and ``candidates`` have task_id, table_seq, pages (array); ``targets`` task_id, page.
    """
    hit = overlapping(original, candidates, targets)
    return original.join(hit, ["task_id", "table_seq"], "left_anti").unionByName(candidates, allowMissingColumns=True)


def merge_targeted_tables(original, candidates, targets: DataFrame):
    """The same of whole :class:`..operators.structure.Tables`: tables, rows and cells; candidates are numbered behind."""
    from ..operators.structure import Tables, stack_tables

    hit = overlapping(table_pages(original.tables, original.rows), candidates.tables, targets)
    kept = Tables(*[d.join(hit, ["task_id", "table_seq"], "left_anti") for d in (original.tables, original.rows, original.cells)])
    return stack_tables(kept, candidates)


def classify_failure(status: Column, message: Column, stdout: Column, stderr: Column, returncode: Column) -> Column:
    """struct<category, recoverable, terminal> of a parser run: the first rule that fits."""
    text = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (status, message, stdout, stderr)]))
    rules = [
        (F.lower(F.coalesce(status, F.lit(""))) == "missing_input", "missing_input"),
        (any_in(text, FAILURES["model_cache_unavailable"]), "model_cache_unavailable"),
        (F.contains(text, F.lit(CONFIG_MISSING)) & any_in(text, FAILURES["model_config_missing"]), "model_config_missing"),
        *[(any_in(text, FAILURES[k]), k) for k in ("resource_exhausted", "remote_backend_unavailable", "timeout")],
        (F.coalesce(returncode, F.lit(0)) != 0, "parser_cli_failed"),
    ]
    category = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit("unknown_parse_failure"))
    missing = category == "missing_input"
    return F.struct(category.alias("category"), (~missing).alias("recoverable"), missing.alias("terminal"))


def last_failure_is_terminal(runs: DataFrame) -> DataFrame:
    """task_id, terminal of the last attempt; false if it didn't fail."""
    return runs.groupBy("task_id").agg(F.coalesce(F.max_by(F.coalesce("failure.terminal", F.lit(False)), "attempt"), F.lit(False)).alias("terminal"))


def cli_options(options: DataFrame) -> Column:
    """The flags of a document parser's command line for a row of options; columns that are absent or null give none."""
    text = lambda c: F.col(c).cast("string")
    values = [F.when(F.col(c).isNotNull(), F.array(F.lit(flag), text(c))) for c, flag in CLI_VALUES if c in options.columns]
    flags = [F.when(F.col(c).isNotNull(), F.array(F.lit(flag), F.initcap(text(c)))) for c, flag in CLI_FLAGS if c in options.columns]
    return F.flatten(F.array_compact(F.array(*values, *flags))) if values or flags else F.array().cast("array<string>")


def model_source(backend: Column, server_url: Column, told: Column, models_here: Column) -> Column:
    """Where a parser's models come from: what the environment says, ``local`` for a local backend whose models lie here, else null."""
    remote = F.lower(F.coalesce(backend, F.lit(""))).isin(*REMOTE) | (F.coalesce(server_url, F.lit("")) != "")
    return F.coalesce(F.nullif(told, F.lit("")), F.when(~remote & F.coalesce(models_here, F.lit(False)), "local"))


def first_existing(places: DataFrame) -> DataFrame:
    """name, path: of each command's candidate places (name, rank, path, there) the first that is there; else the name itself."""
    return places.groupBy("name").agg(F.coalesce(F.min_by("path", F.when(F.col("there"), F.col("rank"))), F.col("name")).alias("path"))


def select_parse_inputs(inputs: DataFrame) -> DataFrame:
    """The inputs that can be parsed: those with a path."""
    return inputs.where(F.coalesce("path", F.lit("")) != "")


def input_decisions(signals: DataFrame) -> DataFrame:
    """task_id, input_index, decision (a struct of texts), tool, backend, method of each input."""
    flag = lambda c: F.col(c).cast("string").alias(c)
    scan = F.col("image_like") | F.col("scanned_hint")
    decision = F.struct("role", "suffix", *[flag(c) for c in ("scanned_hint", "office_like", "html_like", "pdf_like")])
    tool = F.when(F.col("office_like") & ~F.col("pdf_like"), "native_office_or_parser").when(F.col("html_like"), "native_html_parser").when(scan, "document_parser_ocr").otherwise("document_parser")
    method = F.when(scan, "ocr").when(F.col("pdf_like"), "txt").when(F.col("html_like"), "html_table").otherwise("")
    backend = F.when(F.col("pdf_like") | F.col("image_like"), "pipeline").when(F.col("html_like"), "native_html").otherwise("native_or_parser")
    return signals.select("task_id", "input_index", decision.alias("decision"), tool.alias("tool"), backend.alias("backend"), method.alias("method"))


def signal_of_path(paths: DataFrame, inputs: DataFrame) -> DataFrame:
    """A signal for each (task_id, path): that of the task's first input of the path, else of the path alone."""
    first = inputs.where("path is not null").withColumn("rank", F.row_number().over(Window.partitionBy("task_id", "path").orderBy("input_index"))).where("rank = 1").drop("rank")
    return input_signals(paths.join(first, ["task_id", "path"], "left").withColumn("role", F.coalesce("role", F.lit("primary"))))


def attempt_folder(input_index: Column, path: Column, attempt: Column, reason: Column) -> Column:
    """The folder of a parse attempt under the task's: the input's number and stem, and why it was tried."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    base = F.concat_ws("_", input_index.cast("string"), F.coalesce(F.nullif(stem, F.lit("")), F.lit("input")))
    why = F.coalesce(F.nullif(reason, F.lit("")), F.when(attempt != 0, F.concat(F.lit("attempt_"), attempt.cast("string"))))
    return F.concat_ws("_", base, F.regexp_replace(why, r"[^\p{L}\p{N}_-]", "_"))


def step_of_input(inputs: DataFrame, plan: DataFrame) -> DataFrame:
    """task_id, input_index, step, tool: the plan's own parse step of an input, else the task's general one, else null."""
    from ..functions.text import input_slug

    own = F.concat(F.lit("parse_"), input_slug(F.col("input_index").cast("int"), F.col("path"), F.col("url"), F.col("role")))
    steps = plan.select("task_id", F.col("name").alias("step"), "tool")
    wanted = inputs.select("task_id", "input_index", F.posexplode(F.array(own, F.lit("parse_document"))).alias("rank", "step"))
    found = wanted.join(steps, ["task_id", "step"], "left").groupBy("task_id", "input_index").agg(F.min_by(F.struct("step", "tool"), F.when(F.col("tool").isNotNull(), F.col("rank"))).alias("s"))
    return found.select("task_id", "input_index", "s.*")


def find_step(plan: DataFrame, name: str) -> DataFrame:
    return plan.where(F.col("name") == name)


def preflight_route(options: DataFrame, profiles: DataFrame, sample: DataFrame) -> DataFrame:
    """``options`` with the method that a sample of the first pages decides, and planning_reason.

    ``sample`` is the quality of the sampled pages (a row for each task that was sampled; others keep their
    options and get no reason): OCR for scans, and where tables are risky or under 85 % of numbers parse.
    """
    p = profiles.select("task_id", (F.col("scanned_hint") | F.col("has_image")).alias("scan_like"))
    s = sample.select("task_id", ((F.col("table_count") > 0) & ((F.col("risk_level") == "high") | (F.col("numeric_parse_coverage") < 0.85))).alias("risky"))
    both = options.join(p, "task_id", "left").join(s, "task_id", "left")
    ocr = F.col("risky").isNotNull() & (F.coalesce("scan_like", F.lit(False)) | F.col("risky"))
    reason = F.when(F.col("risky").isNull(), None).when(ocr, "preflight_selected_ocr").otherwise("preflight_kept_text")
    return both.withColumn("method", F.when(ocr, "ocr").otherwise(F.col("method"))).withColumn("planning_reason", reason).drop("scan_like", "risky")
