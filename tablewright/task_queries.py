"""More of the query catalogue: whole tasks, sources, structuring, recovery rules and reports, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate, quality, reconcile, references, repair, structure
from .plans import driver, routing, steps
from .queries import cents, query, read
from .sources import artifacts, html, stores


def absent() -> F.Column:
    """A null text."""
    return F.lit(None).cast("string")


def no_strings() -> F.Column:
    return F.array().cast("array<string>")


def balance() -> F.Column:
    """The absolute account balance as text with two decimals."""
    c = F.abs(cents("c_acctbal"))
    return F.concat((c / 100).cast("long").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


BALANCE = "abs(CAST(round(c_acctbal * 100) AS BIGINT))"
PLAIN = f"CAST({BALANCE} // 100 AS VARCHAR) || '.' || lpad(CAST({BALANCE} % 100 AS VARCHAR), 2, '0')"


def pick(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def customer_tasks(spark, sf_dir: str):
    """A filing for each customer: an HTML page or a parser's artifact after zero or one failed attempts."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id") % 4
    raw = F.when(F.col("task_id") % 3 == 1, F.translate(balance(), "01", "Ol")).otherwise(balance())
    tasks = c.select("task_id", F.lit("filing").alias("task_name"), F.lit("report").alias("document_type"), F.lit("extract").alias("goal"), absent().alias("option_backend"), absent().alias("option_method"), absent().alias("server_url"), F.lit(True).alias("auto_recovery"))
    inputs = c.select("task_id", F.lit(0).alias("input_index"), F.concat(F.lit("/in/f"), F.col("task_id").cast("string"), F.when(k == 0, ".html").otherwise(".pdf")).alias("path"), absent().alias("url"), F.lit("primary").alias("role"), absent().alias("mime_type"), F.lit(1.0).alias("size_mb"))
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    key = F.col("task_id").cast("string")
    page = F.concat(F.lit("<title>Filing</title><p>Unit: USD</p><table><caption>Balance</caption><tr><th>Item</th><th>2024</th><th>2023</th></tr><tr><td>Account</td>"), cell(raw), cell(F.lit("7")), F.lit("</tr><tr><td>Key</td>"), cell(key), cell(F.lit("8")), F.lit("</tr></table>"))
    line = lambda label, x, y: F.struct(F.lit(label).alias("label"), F.array(x, F.lit(y)).alias("values"))
    content = F.struct(F.lit("Balance").alias("title"), F.lit("USD").alias("unit"), F.array(F.lit("2024"), F.lit("2023")).alias("periods"), F.array(line("Account", raw, "7"), line("Key", key, "8")).alias("rows"))
    block = F.struct(F.lit("table").alias("type"), F.lit(0).alias("page_idx"), content.alias("content"))
    body = F.when(k == 0, page).when(k == 1, F.to_json(F.array(F.array(block)))).otherwise(F.to_json(F.struct(F.array(block).alias("blocks"))))
    documents = c.where("task_id % 20 <> 0").select("task_id", F.lit(0).alias("input_index"), F.when(k < 2, 0).otherwise(1).alias("attempt"), pick(["html", "v2", "legacy", "legacy"], k).alias("kind"), body.alias("body"))
    said = lambda attempt, status, error: F.struct(F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), F.lit(error).alias("stderr"))
    none = F.lit(None).cast("array<struct<attempt:int,status:string,stderr:string>>")
    outcome = F.when(k == 1, F.array(said(0, "succeeded", ""))).when(k == 2, F.array(said(0, "failed", "request timed out"), said(1, "succeeded", ""))).when(k == 3, F.array(said(0, "missing_input", ""), said(1, "succeeded", ""))).otherwise(none)
    runs = c.select("task_id", F.lit(0).alias("input_index"), F.explode(outcome).alias("r")).select("task_id", "input_index", "r.*", absent().alias("message"), absent().alias("stdout"), F.lit(0).alias("returncode"))
    return tasks, inputs, documents, runs


@query(f"""
WITH c AS (SELECT c_custkey AS task_id, {PLAIN} AS plain, {BALANCE} AS cents, c_custkey % 4 = 3 OR c_custkey % 20 = 0 AS bad FROM customer),
r AS (SELECT *, task_id % 3 = 1 AND regexp_matches(plain, '[01]') AS damaged, regexp_matches(plain, '[2-9]') AS readable FROM c)
SELECT task_id, CASE WHEN bad THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN NOT bad THEN 1::BIGINT END AS table_count, CASE WHEN NOT bad THEN 2::BIGINT END AS row_count, CASE WHEN NOT bad THEN 'low' END AS risk_level,
  CASE WHEN NOT bad THEN (damaged AND readable)::INT::BIGINT END AS repair_count, CASE WHEN NOT bad AND (readable OR NOT damaged) THEN cents END AS account_cents,
  CASE WHEN NOT bad THEN 'Parsed 1 tables with 2 rows. Validation pass rate: 100.00%. Warnings: 0; failures: 0; repairs: ' || CAST((damaged AND readable)::INT AS VARCHAR) || '.' WHEN task_id % 4 = 0 THEN 'Native HTML parsing failed.' ELSE 'Parsing failed after recovery attempts.' END AS summary FROM r
""")
def task_pipeline(spark, sf_dir):
    """Every stage over a task a customer."""
    results = driver.run_tasks(*customer_tasks(spark, sf_dir)).results
    first = F.col("tables")[0]["rows"][0]["cells"][0]["value"]
    return results.select("task_id", "status", F.col("quality.table_count").alias("table_count"), F.col("quality.row_count").alias("row_count"), F.col("quality.risk_level").alias("risk_level"), F.col("quality.repairs.repair_count").alias("repair_count"), F.round(first * 100).cast("long").alias("account_cents"), "summary")


SOAK_PAGE = "<title>Balance</title><p>单位：人民币百万元</p><table><tr><th rowspan=2>Item</th><th colspan=2>Year</th></tr><tr><th>FY2025</th><th>FY2024</th></tr><tr><td>Revenue</td><td>1,250</td><td>1,080</td></tr><tr><td>Loss</td><td>(215)</td><td>180</td></tr></table>"


@query("SELECT 100::BIGINT AS task_count, 100::BIGINT AS succeeded_count, 1.0::DOUBLE AS artifact_coverage, 1::BIGINT AS unique_result_hash_count, 1::BIGINT AS output_shape_count, 100::BIGINT AS total_tables, 200::BIGINT AS total_rows, 0::BIGINT AS hard_failures, 'pass' AS status")
def html_soak(spark, sf_dir):
    """A hundred equal HTML tasks through the whole engine, and the report on them."""
    n = spark.range(100).select(F.col("id").alias("task_id"))
    tasks = n.select("task_id", F.lit("soak").alias("task_name"), F.lit("html_financial_table").alias("document_type"), F.lit("extract").alias("goal"), absent().alias("option_backend"), absent().alias("option_method"), absent().alias("server_url"), F.lit(True).alias("auto_recovery"))
    inputs = n.select("task_id", F.lit(0).alias("input_index"), F.lit("/in/page.html").alias("path"), absent().alias("url"), F.lit("primary").alias("role"), absent().alias("mime_type"), F.lit(0.1).alias("size_mb"))
    documents = n.select("task_id", F.lit(0).alias("input_index"), F.lit(0).alias("attempt"), F.lit("html").alias("kind"), F.lit(SOAK_PAGE).alias("body"))
    runs = spark.createDataFrame([], "task_id long, input_index int, attempt int, status string, message string, stdout string, stderr string, returncode int")
    run = driver.run_tasks(tasks, inputs, documents, runs)
    kept = lambda d, name: d.select("task_id").distinct().withColumn(name, F.lit(True))
    q = F.col("quality")
    rows = run.results.select("task_id", "status", F.lit(0.0).alias("elapsed"), *[q[c].alias(c) for c in ("table_count", "row_count", "failed_count", "warning_count", "numeric_parse_coverage", "evidence_coverage")], F.sha2(F.to_json(F.struct("tables", "quality")), 256).alias("result_hash"), F.lit(True).alias("result_exists"))
    rows = rows.join(kept(run.plan, "plan_exists"), "task_id", "left").join(kept(run.trace, "trace_exists"), "task_id", "left").fillna(False, ["plan_exists", "trace_exists"])
    return evaluate.soak_report(rows).select("task_count", "succeeded_count", "artifact_coverage", "unique_result_hash_count", "output_shape_count", "total_tables", "total_rows", "hard_failures", "status")


@query("SELECT n_regionkey AS task_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS page_idx, n_name AS title, 'EUR' AS unit, n_name || ' total' AS item, CAST(n_nationkey AS BIGINT) AS value FROM nation")
def html_ingest(spark, sf_dir):
    """Pages with a table for each nation of a region re-enter the block path."""
    n = read(spark, sf_dir, "nation")
    table = F.concat(F.lit("<div><table><caption>"), "n_name", F.lit("</caption><tr><th>Item</th><th>Key</th></tr><tr><td>"), "n_name", F.lit(" total</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr></table></div>"))
    pages = n.groupBy(F.col("n_regionkey").alias("task_id")).agg(F.concat(F.lit("<p>Unit: EUR</p>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", table.alias("t")))), lambda x: x["t"]), "\n")).alias("html"))
    blocks = structure.block_texts(structure.classify(html.html_blocks(pages)))
    t = structure.normalize_tables(structure.carry_context(blocks, ["task_id"]))
    key = ["task_id", "table_seq"]
    return t.cells.join(t.rows, [*key, "row_seq"]).join(t.tables.select(*key, "title", "unit", "page_start"), key).select("task_id", F.col("page_start").alias("page_idx"), "title", "unit", "item", F.col("value").cast("long").alias("value"))


def _json_sources(spark, sf_dir):
    """Each order's lines as a flat list, and as page records whose first list may be empty."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    block = F.struct(F.lit("text").alias("type"), F.col("l_partkey").cast("string").alias("text"))
    g = li.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", block.alias("b")))), lambda x: x["b"]).alias("x"))
    flat = g.select("task_id", F.to_json(F.struct(F.col("x").alias("items"), F.lit(1).alias("version"))).alias("json"))
    empty = F.array().cast("array<struct<type:string,text:string>>")
    page = F.struct(F.lit(7).alias("page_idx"), F.when(F.col("task_id") % 2 == 0, F.col("x")).otherwise(empty).alias("preproc_blocks"), F.col("x").alias("para_blocks"))
    return flat, g.select("task_id", F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("json"))


@query("SELECT l_orderkey AS task_id, CAST(NULL AS INTEGER) AS page_idx, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY ALL")
def blocks_flatten_legacy(spark, sf_dir):
    return artifacts.flatten_legacy(_json_sources(spark, sf_dir)[0]).groupBy("task_id", "page_idx").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("parts"))


@query("SELECT l_orderkey AS task_id, 7 AS page_idx, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY ALL")
def blocks_flatten_middle(spark, sf_dir):
    return artifacts.flatten_middle(_json_sources(spark, sf_dir)[1]).groupBy("task_id", "page_idx").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("parts"))


@query("SELECT l_orderkey AS task_id, CASE WHEN l_orderkey % 3 = 0 THEN 'flat' ELSE 'middle' END AS source, count(*) AS n FROM lineitem GROUP BY ALL")
def source_preference(spark, sf_dir):
    flat, middle = _json_sources(spark, sf_dir)
    some = artifacts.flatten_legacy(flat.withColumn("json", F.when(F.col("task_id") % 3 == 0, F.col("json")).otherwise('{"items": []}')).where("json <> '{\"items\": []}'"))
    return artifacts.prefer_blocks(some, artifacts.flatten_middle(middle)).groupBy("task_id", F.when(F.col("page_idx") == 7, "middle").otherwise("flat").alias("source")).agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT unnest(['content_list', 'content_list_v2', 'layout', 'markdown', 'middle', 'model', 'span']) AS kind)
SELECT kind, '/run/p' || CAST((SELECT min(p_partkey) FROM part) AS VARCHAR) || CASE kind WHEN 'markdown' THEN '.md' WHEN 'span' THEN '/span.pdf' WHEN 'layout' THEN '_layout.pdf' ELSE '_' || kind || '.json' END AS path FROM k
""")
def artifact_pick(spark, sf_dir):
    least = read(spark, sf_dir, "part").agg(F.min("p_partkey").alias("p"))
    ends = [".md", "_content_list.json", "_content_list_v2.json", "_middle.json", "_model.json", "_layout.pdf", "/layout.pdf", "/span.pdf", ".txt"]
    files = read(spark, sf_dir, "part", "p_partkey").join(F.broadcast(least), F.col("p_partkey") <= F.col("p") + 8).select(F.explode(F.array(*[F.concat(F.lit("/run/p"), F.col("p_partkey").cast("string"), F.lit(e)) for e in ends])).alias("path"))
    return artifacts.pick_artifacts(files)


@query("SELECT user_id AS task_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def task_store_latest(spark, sf_dir):
    return artifacts.latest_tasks(read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("status"))).select("task_id", "status")


@query("""
SELECT 'n' || n_name AS task_name, 't' || CAST(n_nationkey AS VARCHAR) AS task_id, CASE n_nationkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'running' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS summary, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::BIGINT END AS table_count FROM nation
""")
def task_map_summary(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    key = F.concat(F.lit("t"), F.col("n_nationkey").cast("string"))
    entry = F.concat(F.lit('"n'), "n_name", F.lit('": '), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(F.concat(F.lit('{"task_id": "'), key, F.lit('"}'))))
    files = n.groupBy("n_regionkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit(', "odd": 5}')).alias("json"))
    held = n.where("n_nationkey % 3 < 2").select(F.concat(F.lit("/runs/"), key, F.when(F.col("n_nationkey") % 3 == 0, "/result.json").otherwise("/trace.jsonl")).alias("path"), F.lit('{"status": "succeeded"}').alias("json"))
    nothing = {c: F.lit(None).cast("double").alias(c) for c in ("failed_count", "warning_count", "numeric_parse_coverage", "evidence_coverage", "financial_table_count")}
    results = n.where("n_nationkey % 3 = 0").select(key.alias("task_id"), F.col("n_name").alias("summary"), F.col("n_nationkey").cast("long").alias("table_count"), *nothing.values())
    return stores.map_summary(stores.task_map(files), results, stores.local_status(held)).select("task_name", "task_id", "status", "summary", "table_count")


@query("SELECT c_custkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN 'saved' WHEN c_custkey % 3 = 0 THEN 'fallback' ELSE 'last' END AS place FROM customer")
def saved_result_fallback(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    of = lambda d, place: d.withColumn("place", F.lit(place))
    return stores.prefer_rows(of(c.where("task_id % 2 = 0"), "saved"), of(c.where("task_id % 3 = 0"), "fallback"), of(c, "last"))


@query(f"""
WITH c AS (SELECT c_custkey AS task_id, {BALANCE} AS cents FROM customer)
SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'row_0' ELSE 'Account' END AS item, period, CASE period WHEN 'FY' THEN cents WHEN 'col_2' THEN 100 * task_id ELSE 700 END AS cents, 'grid_table_p3_' || CAST(task_id AS VARCHAR) AS name FROM c, (SELECT unnest(['FY', 'col_2', 'col_2 ']) AS period) WHERE period <> 'col_2 '
""")
def grid_normalize(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    blank = F.array(F.lit(" "), F.lit(""))
    row = F.array(F.when(F.col("c_custkey") % 2 == 0, "").otherwise("Account"), balance(), F.col("c_custkey").cast("string"))
    grids = c.select(F.col("c_custkey").alias("task_id"), F.lit(3).alias("page"), F.col("c_custkey").alias("table_index"), F.array(blank, F.array(F.lit("Item"), F.lit(" FY "), F.lit("")), row, F.array(F.lit("alone"))).alias("grid"))
    tables, rows, cells = stores.grid_tables(grids.union(grids.select("task_id", F.lit(4), "table_index", F.slice("grid", 1, 2))))
    key = ["task_id", "page", "table_index"]
    return cells.join(rows, [*key, "row_seq"]).join(tables.select(*key, "name"), key).select("task_id", "item", "period", F.round(F.col("value") * 100).cast("long").alias("cents"), "name")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE '' END AS first, CASE WHEN c_custkey % 4 = 0 THEN 9 ELSE greatest(CAST(c_custkey % 4 - 2 AS INTEGER), 1) END AS span, CASE WHEN c_custkey % 2 = 0 THEN CAST(1990 + c_custkey % 30 AS VARCHAR) ELSE '' END AS year,
  'input_0' || CAST(c_custkey % 7 AS VARCHAR) || '_' || CASE WHEN c_custkey % 2 = 0 THEN 'customer_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '_v1' ELSE 'audit' END AS slug, ['low', 'medium', 'high', 'odd'][c_custkey % 4 + 1] AS risk, [0, 1, 2, 1][c_custkey % 4 + 1] AS rank FROM customer
""")
def scalar_helpers(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    risk = pick(["low", "medium", "high", "odd"], k % 4)
    path = F.when(k % 2 == 0, F.concat(F.lit("/a.b/Customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" v1.PDF"))).otherwise("/a/--.pdf")
    return c.select(
        "c_custkey", T.first_text(F.when(k % 3 == 0, F.col("c_name")).otherwise(" \t"), F.when(k % 3 == 1, F.col("c_mktsegment"))).alias("first"), T.safe_int(F.when(k % 4 == 0, "x").otherwise((k % 4 - 2).cast("string")), 9).alias("span"),
        T.year_from_text(F.when(k % 2 == 0, F.concat(F.lit("in 1234 or "), (1990 + k % 30).cast("string"), F.lit(" and 2031"))).otherwise("in 1899 or 2199")).alias("year"), T.input_slug((k % 7).cast("int"), path, absent(), F.lit("audit")).alias("slug"), risk.alias("risk"), T.risk_rank(risk).alias("rank"),
    )


@query("""
SELECT c_custkey, ['rate', 'growth', 'amount', 'revenue', 'cash_flow'][c_custkey % 5 + 1] AS kind, ['this margin', 'the growth', 'the value', 'this Revenue', 'the cash flow'][c_custkey % 5 + 1] AS phrase FROM customer
""")
def mention_extract(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    said = F.concat("c_name", F.lit(" says: "), pick(["this  margin", "the growth", "the value", "this Revenue", "the cash flow"], F.col("c_custkey") % 5), F.lit(" again "), pick(["this  margin", "the growth", "the value", "this Revenue", "the cash flow"], F.col("c_custkey") % 5))
    return c.select("c_custkey", F.explode(T.reference_mentions(said)).alias("m")).select("c_custkey", "m.*")


@query("SELECT c_custkey, round(least(1.0, (c_custkey % 6) / 4.0), 4)::DOUBLE AS relevance FROM customer")
def relevance_score(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey")
    words = F.array(*[F.lit(w) for w in ("net revenue", "equity", "debts", "other expense", "资产")])
    return c.select("c_custkey", T.financial_relevance(F.array_join(F.slice(words, F.lit(1), (F.col("c_custkey") % 6).cast("int")), " ")).alias("relevance"))


def _typed_blocks(spark, sf_dir) -> DataFrame:
    """A block for each customer: title, paragraph, table, chart, plain text or an odd object."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey") % 6
    name = F.col("c_name")
    to = lambda field: F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), name.alias("content"))).alias(field)))
    content = F.when(k == 0, to("title_content")).when(k == 1, to("paragraph_content")).when(k == 2, '{"html": "<table></table>"}').when(k == 3, '{"series": []}').when(k == 4, F.to_json(F.struct(name.alias("x")))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    return c.select(F.col("c_custkey").alias("task_id"), F.lit(0).cast("long").alias("block_seq"), F.lit(0).alias("page_idx"), pick(["Title", "text", "x", "y", "z", "doc_title"], k).alias("block_type"), absent().alias("bbox"), F.parse_json(content).alias("content"), absent().alias("title"), absent().alias("text"))


@query("""
SELECT c_custkey AS task_id, c_custkey % 6 = 2 AS is_table, c_custkey % 6 = 3 AS is_chart, c_custkey % 6 IN (0, 5) AS is_heading, CASE WHEN c_custkey % 6 IN (0, 1, 5) THEN c_name ELSE '' END AS block_text, CASE WHEN c_custkey % 6 IN (0, 1, 5) THEN c_name ELSE '' END AS heading_text FROM customer
""")
def block_classify(spark, sf_dir):
    return structure.block_texts(structure.classify(_typed_blocks(spark, sf_dir))).select("task_id", "is_table", "is_chart", "is_heading", "block_text", "heading_text")


def order_tables(spark, sf_dir) -> structure.Tables:
    """Each order as a table block, a row for each line with four values, one of them not a number in every fifth."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    text = lambda c: (F.round(F.col(c) * 100).cast("long")).cast("string")
    bad = (F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0
    values = F.array(text("l_quantity"), F.concat(F.lit("USD "), text("l_extendedprice")), text("l_discount"), F.when(bad, "n/k").otherwise(text("l_tax")))
    row = F.struct(F.concat(F.lit(" Line "), F.col("l_linenumber").cast("string")).alias("label"), values.alias("values"))
    g = li.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    content = F.struct(F.lit("Order lines").alias("title"), F.lit("USD cents").alias("unit"), F.array(*[F.lit(p) for p in ("quantity", "price", "discount", "tax")]).alias("periods"), F.col("rows"))
    blocks = g.select("task_id", F.lit(0).cast("long").alias("block_seq"), F.lit(2).alias("page_idx"), F.lit("table").alias("block_type"), F.lit("[0,1,2,3]").alias("bbox"), F.parse_json(F.to_json(content)).alias("content"), absent().alias("title"), absent().alias("text"), absent().alias("context_title"), absent().alias("context_unit"), F.lit("primary").alias("role"))
    return structure.normalize_tables(structure.classify(blocks))


LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, (l_orderkey + l_linenumber) % 5 = 0 AS bad FROM lineitem"


@query(f"""
SELECT l_orderkey AS task_id, 'Line ' || CAST(l_linenumber AS VARCHAR) AS item, period, 'primary' AS role, CASE WHEN period = 'tax' AND bad THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS value FROM (
  SELECT l_orderkey, l_linenumber, bad, unnest(['quantity', 'price', 'discount', 'tax']) AS period, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM ({LINES}))
""")
def normalize_cells(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    return structure.unfolded(structure.lines_of(structure.nested(t))).select("task_id", "item", "period", "role", F.col("value").cast("long").alias("value"))


@query(f"""
SELECT l_orderkey AS task_id, 'order_lines' AS "table", 'Line ' || CAST(l_linenumber AS VARCHAR) AS label, period, CAST(round(value * 100) AS BIGINT) AS value, 'USD cents' AS unit, 2 AS page, 'amount' AS metric_kind FROM (
  SELECT l_orderkey, l_linenumber, bad, unnest(['quantity', 'price', 'discount', 'tax']) AS period, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM ({LINES})) WHERE NOT (period = 'tax' AND bad)
""")
def metric_candidates(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    return references.metric_candidates(t).select("task_id", "table", "label", "period", F.col("value").cast("long").alias("value"), "unit", "page", "metric_kind")


@query(f"""
WITH b AS (SELECT l_orderkey, bool_or(bad) AS bad, count(*) AS n FROM ({LINES}) GROUP BY 1)
SELECT l_orderkey AS task_id, name, what, status FROM (
  SELECT l_orderkey, unnest(['min_row_count', 'max_warning_count', 'required_table', 'required_table']) AS name, unnest(['3.0', '0.0', 'ORDER', 'cash']) AS what, unnest([CASE WHEN n >= 3 THEN 'pass' ELSE 'fail' END, 'pass', 'pass', 'fail']) AS status FROM b)
UNION ALL SELECT l_orderkey, 'required_metric', CAST(l_orderkey AS VARCHAR), CASE WHEN count(*) FILTER (l_linenumber = 1 AND round(l_quantity * 100) = 100 * (l_orderkey % 50)) > 0 THEN 'pass' ELSE 'fail' END FROM lineitem GROUP BY 1
""")
def result_evaluation(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    tasks = t.tables.select("task_id")
    q = quality.quality(tasks, quality.table_diagnostics(t.tables, t.rows, t.cells), quality.verify(t.tables, t.rows, t.cells))
    expected = tasks.withColumns({"min_row_count": F.lit(3), "max_warning_count": F.lit(0), "min_table_count": F.lit(None).cast("int")})
    tokens = tasks.withColumn("token", F.explode(F.array(F.lit("ORDER"), F.lit("cash"))))
    metrics = tasks.select("task_id", F.col("task_id").alias("metric_id"), F.lit("order").alias("table_contains"), F.lit("line 1").alias("row_contains"), F.lit("usd").alias("unit_contains"), F.lit("quantity").alias("period"), (F.col("task_id") % 50 * 100).cast("double").alias("expected_value"), F.lit(0.0).alias("tolerance"), F.lit(True).alias("evidence_required"))
    return evaluate.evaluate_results(t, q, expected, tokens, metrics)[0]


@query("""
WITH s AS (SELECT l_orderkey, arg_max(round(l_quantity * 100), l_partkey) FILTER (l_linenumber = 1) AS q, count(DISTINCT l_linenumber) AS labels, count(*) AS n, count(*) FILTER (l_linenumber = 1) > 0 AS one, count(*) FILTER (l_linenumber = 2) > 0 AS two FROM lineitem GROUP BY 1)
SELECT l_orderkey AS case_id, 0.5::DOUBLE AS header_precision, 1.0::DOUBLE AS header_recall, round((one::INT + two::INT) / n, 4)::DOUBLE AS row_precision, round((one::INT + two::INT) / 2, 4)::DOUBLE AS row_recall, CASE WHEN q IS NOT NULL AND abs(q - 2500) <= 1000 THEN 1.0 ELSE 0.0 END::DOUBLE AS numeric_exact_match,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS cross_page_merge_accuracy, CASE WHEN l_orderkey % 2 = 0 THEN 1.0 END::DOUBLE AS unit_inheritance_accuracy, 'fail' AS status FROM s
""")
def layout_cases(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    k = F.col("task_id")
    cases = t.tables.select(k.alias("case_id"), "task_id", F.lit("Order Lines").alias("expected_table"), F.when(k % 2 == 0, "usd").alias("expected_unit"), F.when(k % 3 > 0, 2).alias("page_start"), F.when(k % 3 == 1, 2).when(k % 3 == 2, 9).alias("page_end"))
    labels = lambda *xs: cases.select("case_id", F.explode(F.array(*[F.lit(x) for x in xs])).alias("label"))
    values = cases.select("case_id", F.lit("LINE 1").alias("row"), F.lit("quantity").alias("period"), F.lit(2500.0).alias("value"), F.lit(1000.0).alias("tolerance"))
    return evaluate.layout_report(t, cases, labels("Quantity", "tax"), labels("Line 1", "line  2"), values)


@query("""
WITH s AS (SELECT l_orderkey AS id, coalesce(arg_max(round(l_quantity * 100), l_partkey) FILTER (l_linenumber = 1) = 100 * (l_orderkey % 50), false) AS hit, count(*) FILTER (l_linenumber = 3) > 0 AS three FROM lineitem GROUP BY 1),
c AS (SELECT id, id % 4 = 0 AS lost, id % 2 = 0 AS warned, hit, three FROM s)
SELECT id AS case_id, CASE WHEN lost OR NOT hit OR NOT warned OR id % 3 = 1 OR three THEN 'fail' ELSE 'pass' END AS status, 6::BIGINT AS check_count, 1::BIGINT AS required_metric_count, (hit AND NOT lost)::INT::BIGINT AS required_metric_passed, CASE WHEN hit AND NOT lost THEN 1.0 ELSE 0.0 END::DOUBLE AS required_metric_accuracy FROM c
""")
def edge_cases(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    k = F.col("task_id")
    cases = t.tables.select(k.alias("case_id"), "task_id", F.when(k % 4 == 0, "nowhere").otherwise("order").alias("expected_table"), F.lit("noise").alias("expected_warning_type"))
    of = cases.select("case_id", "task_id")
    metrics = of.select("case_id", F.lit("line 1").alias("row"), F.lit("quantity").alias("period"), (k % 50 * 100).cast("double").alias("value"))
    flags, observed = of.select("case_id", F.lit("noise_rejected").alias("flag"), F.lit("true").alias("expected")), of.select("task_id", F.lit("noise_rejected").alias("flag"), F.when(k % 3 == 1, "false").otherwise("true").alias("value"))
    warnings = of.where(k % 2 == 0).select("task_id", F.lit("noise").alias("type"))
    checks = evaluate.edge_checks(t, cases, metrics, of.select("case_id", F.lit("TAX").alias("label")), of.select("case_id", F.lit("Line 3").alias("token")), flags, warnings, observed)
    return evaluate.edge_report(checks)


@query(f"""
SELECT c_custkey AS task_id, 'Account' AS "row", '2024' AS period, {PLAIN} AS repaired, 'ocr_digit_confusion' AS reason, CASE WHEN c_custkey % 2 = 0 THEN 92 ELSE 88 END::BIGINT AS confidence, 7::BIGINT AS peer FROM customer
WHERE regexp_matches({PLAIN}, '[01]') AND regexp_matches({PLAIN}, '[2-9]')
""")
def repair_records(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    key = [F.col("c_custkey").alias("task_id"), F.lit(0).alias("table_seq")]
    tables = c.select(*key, F.lit("t").alias("name"), F.lit("T").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "USD").otherwise("").alias("unit"), F.lit("note").alias("footnote"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), absent().alias("bbox"))
    rows = c.select(*key, F.lit(0).alias("row_seq"), F.lit("Account").alias("item"), F.lit(1).alias("page"), absent().alias("bbox"))
    cells = c.select(*key, F.lit(0).alias("row_seq"), F.posexplode(F.array(F.struct(F.lit("2024").alias("period"), F.translate(balance(), "01", "Ol").alias("raw")), F.struct(F.lit("2023").alias("period"), F.lit("7").alias("raw")))).alias("cell_index", "x")).select("task_id", "table_seq", "row_seq", "cell_index", "x.*").withColumn("value", T.parse_number("raw"))
    r = repair.repair_cells(tables, rows, cells)[1]
    return r.select("task_id", "row", "period", "repaired", "reason", F.round(F.col("confidence") * 100).cast("long").alias("confidence"), F.col("context_evidence.peer_values")[0]["value"].cast("long").alias("peer"))


@query("""
SELECT c_nationkey AS task_id, count(*) FILTER (c_custkey % 3 = 0) AS matched_metric_count, count(*) FILTER (c_custkey % 3 <> 0) AS conflict_count, count(*) FILTER (c_custkey % 3 <> 0) > 20 AS truncated, least(20, count(*) FILTER (c_custkey % 3 <> 0)) AS shown FROM customer GROUP BY 1
""")
def conflict_report(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name")
    side = lambda role, value: F.struct(F.lit(role).alias("role"), value.cast("double").alias("value"))
    records = c.select(F.col("c_nationkey").alias("task_id"), F.col("c_name").alias("metric"), F.lit("2024").alias("period"), F.explode(F.array(side("primary", F.lit(100)), side("attachment", F.when(F.col("c_custkey") % 3 == 0, 101).otherwise(150)))).alias("s")).select("task_id", "metric", "period", "s.*")
    r = reconcile.conflict_report(reconcile.reconcile(records), records)
    return r.select("task_id", "matched_metric_count", "conflict_count", "truncated", F.size("conflicts").cast("long").alias("shown"))


@query("SELECT conv_id AS task_id, role, count(*) AS n FROM conversations WHERE role IS NOT NULL AND role <> '' GROUP BY ALL")
def block_roles(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "role").where("role is not null and role <> ''")
    return reconcile.role_counts(c.withColumnRenamed("conv_id", "task_id"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS a, c_custkey % 3 AS b FROM customer)
SELECT id AS task_id, a = 0 OR b = 0 AS retry, CASE WHEN NOT (a = 0 OR b = 0) THEN NULL WHEN a = 0 THEN 1 WHEN id % 5 = 0 THEN 2 END AS attempt FROM c
""")
def recovery_choice(spark, sf_dir):
    """Failures (a = 0) or poor numbers (b = 0) ask for a retry; the first that fails less or reads 0.03 more is taken."""
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id")
    record = lambda failed, numeric: [failed.cast("int").alias("failed_count"), F.lit("medium").alias("risk_level"), F.lit(3).alias("table_count"), numeric.alias("numeric_parse_coverage"), F.lit(0.9).alias("evidence_coverage")]
    base = c.select("task_id", *record(k % 4 == 0, F.when(k % 3 == 0, 0.5).otherwise(0.9)))
    tries = c.select("task_id", F.lit(1).alias("attempt"), *record(F.lit(0), F.when(k % 3 == 0, 0.52).otherwise(0.9))).union(c.select("task_id", F.lit(2), *record((k % 4 == 0), F.when(k % 5 == 0, 0.99).otherwise(0.5))))
    return base.select("task_id", routing.should_retry().alias("retry")).join(routing.recover(base, tries), "task_id")


@query("SELECT c_custkey AS task_id, c_custkey % 3 = 1 AS terminal FROM customer")
def terminal_failures(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    runs = c.select("task_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    last = F.when(F.col("attempt") == 1, F.when(F.col("task_id") % 3 == 1, "missing_input").when(F.col("task_id") % 3 == 2, "failed")).otherwise("missing_input")
    failure = F.when(last.isNotNull(), routing.classify_failure(last, absent(), absent(), absent(), F.lit(1)))
    return routing.last_failure_is_terminal(runs.withColumn("failure", failure))


@query("""
WITH c AS (SELECT c_custkey AS id, (c_custkey % 9)::INT AS lo, (c_custkey % 9 + c_custkey % 16)::INT AS hi FROM customer WHERE c_custkey % 4 <> 0)
SELECT id AS task_id, lo AS start_page, hi AS end_page, CAST(hi - lo + 1 AS BIGINT) AS pages FROM c WHERE hi - lo <= 12
""")
def targeted_windows(spark, sf_dir):
    """Tables with failures, few numbers or little evidence say which pages an OCR retry takes, if they lie close together."""
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id")
    d = c.select("task_id", F.lit(0).alias("table_seq"), (k % 9).cast("int").alias("page_start"), (k % 9 + k % 16).cast("int").alias("page_end"), F.when(k % 4 == 1, 0.5).otherwise(1.0).alias("numeric_parse_coverage"), F.when(k % 4 == 2, 0.5).otherwise(1.0).alias("evidence_coverage"))
    checks = c.select("task_id", F.lit(0).alias("table_seq"), F.when(k % 4 == 3, "fail").otherwise("pass").alias("status"))
    w = routing.targeted_window(routing.attention_pages(d, checks))
    return w.select("task_id", "start_page", "end_page", F.size("target_pages").cast("long").alias("pages"))


def _routed(spark, sf_dir):
    """A PDF or a page for each customer, and a scanned attachment beside it in every third."""
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id")
    tasks = c.select("task_id", F.lit("filing").alias("task_name"), F.lit("annual_report").alias("document_type"), F.lit("extract").alias("goal"))
    part = lambda i, path, role: F.struct(F.lit(i).alias("input_index"), path.alias("path"), F.lit(role).alias("role"))
    second = F.when(k % 3 == 0, part(1, F.lit("/in/scan.png"), "attachment"))
    inputs = c.select("task_id", F.explode(F.array_compact(F.array(part(0, F.when(k % 2 == 0, "/in/Main Doc.pdf").otherwise("/in/page.html"), "primary"), second))).alias("i")).select("task_id", "i.*", absent().alias("url"), absent().alias("mime_type"), F.lit(1.0).alias("size_mb"))
    return tasks, inputs, *driver.plan_tasks(tasks, inputs)


@query("""
SELECT c_custkey AS task_id, CASE WHEN c_custkey % 3 = 0 THEN 15 ELSE 8 END::BIGINT AS step_count, CASE WHEN c_custkey % 3 = 0 THEN 16 ELSE 7 END::BIGINT AS edge_count, CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE 8 END::BIGINT AS level_count, true AS is_dag FROM customer
""")
def plan_build(spark, sf_dir):
    """Linear plans, and mixed ones where a task has several documents."""
    plan = _routed(spark, sf_dir)[4]
    edges = steps.edges_of(plan)
    s = steps.graph_summary(plan, steps.plan_levels(plan, edges), edges)
    return s.select("task_id", "step_count", "edge_count", F.col("level_count").cast("long").alias("level_count"), "is_dag")


@query("""
WITH i AS (SELECT c_custkey AS task_id, 0 AS input_index FROM customer UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0)
SELECT task_id, input_index, CASE WHEN task_id % 3 <> 0 THEN 'parse_document' WHEN input_index = 1 THEN 'parse_input_01_scan' WHEN task_id % 2 = 0 THEN 'parse_input_00_main_doc' ELSE 'parse_input_00_page' END AS step,
  CASE WHEN input_index = 1 THEN 'document_parser_ocr' WHEN task_id % 2 = 0 THEN 'document_parser' ELSE 'native_html_parser' END AS tool, CASE WHEN input_index = 1 OR task_id % 2 = 0 THEN 'pipeline' ELSE 'native_html' END AS backend, CASE WHEN input_index = 1 THEN 'ocr' WHEN task_id % 2 = 0 THEN 'txt' ELSE 'html_table' END AS method,
  CASE WHEN input_index = 1 THEN '1_scan_retry_with_ocr' WHEN task_id % 2 = 0 THEN '0_Main Doc' ELSE '0_page_attempt_2' END AS folder FROM i
""")
def input_steps(spark, sf_dir):
    """Of each input: its parse step, tool, backend, method, and the folder of an attempt."""
    _, inputs, signals, _, plan = _routed(spark, sf_dir)
    key = ["task_id", "input_index"]
    found = routing.step_of_input(inputs, plan).select(*key, "step").join(routing.input_decisions(signals).drop("decision"), key).join(inputs.select(*key, "path"), key)
    i = F.col("input_index")
    attempt, reason = F.when((i == 0) & (F.col("path").endswith("html")), 2).otherwise(0), F.when(i == 1, "retry_with_ocr")
    return found.select(*key, "step", "tool", "backend", "method", routing.attempt_folder(i, F.col("path"), attempt, reason).alias("folder"))


@query("""
SELECT c_custkey AS task_id, 'pipeline' AS backend, CASE WHEN c_custkey % 3 = 1 THEN 'ocr' ELSE 'txt' END AS method, CASE c_custkey % 3 WHEN 1 THEN 'preflight_selected_ocr' WHEN 2 THEN 'preflight_kept_text' END AS planning_reason, '-m ' || CASE WHEN c_custkey % 3 = 1 THEN 'ocr' ELSE 'txt' END || ' -b pipeline -s 1 -f True' AS flags, CASE WHEN c_custkey % 2 = 0 THEN 'local' END AS models FROM customer
""")
def option_route(spark, sf_dir):
    """Options of a PDF after a sample of its pages, as command-line flags, and where its models come from."""
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id")
    inputs = c.select("task_id", F.lit(0).alias("input_index"), F.lit("/a/x.pdf").alias("path"), absent().alias("url"), F.lit("primary").alias("role"), absent().alias("mime_type"), F.lit("t").alias("task_name"), F.lit("report").alias("document_type"), F.lit(1.0).alias("size_mb"))
    based = routing.base_options(routing.input_signals(inputs).withColumns({"option_backend": absent(), "option_method": absent()}))
    profiles = c.select("task_id", F.lit(False).alias("scanned_hint"), F.lit(False).alias("has_image"))
    sample = c.where(k % 3 > 0).select("task_id", F.lit(2).alias("table_count"), F.lit("medium").alias("risk_level"), F.when(k % 3 == 1, 0.5).otherwise(0.9).alias("numeric_parse_coverage"))
    routed = routing.preflight_route(based, profiles, sample).withColumns({"start_page": F.lit(1), "formula": F.lit(True)})
    return routed.select("task_id", "backend", "method", "planning_reason", F.array_join(routing.cli_options(routed), " ").alias("flags"), routing.model_source(F.col("backend"), absent(), absent(), k % 2 == 0).alias("models"))


@query("""
SELECT c_custkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN 'audit' ELSE 'primary' END AS role, c_custkey % 2 = 0 AS pdf_like, c_custkey % 5 = 0 AS needs FROM customer
""")
def path_profile(spark, sf_dir):
    """The signal of a path: of the input that has it, else of the path alone; and whether a sample should be read first."""
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id")
    inputs = c.where(k % 2 == 0).select("task_id", F.lit("/a/x.bin").alias("path"), F.lit(0).alias("input_index"), absent().alias("url"), F.lit("audit").alias("role"), F.lit("application/pdf").alias("mime_type"), F.lit("t").alias("task_name"), F.lit("r").alias("document_type"), F.lit(1.0).alias("size_mb"))
    found = routing.signal_of_path(c.select("task_id", F.lit("/a/x.bin").alias("path")), inputs)
    options = c.select("task_id", F.lit(True).alias("preflight"), F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.lit(".pdf").alias("suffix"), (k % 5 == 0).alias("large_document_hint"), F.lit("TXT").alias("method"))
    return found.select("task_id", "role", "pdf_like").join(options.select("task_id", routing.needs_preflight(options).alias("needs")), "task_id")


@query("""
SELECT n_nationkey AS task_id, CASE WHEN n_nationkey % 2 = 0 THEN 'the growth' ELSE 'this amount' END AS item, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 100 + n_nationkey END::BIGINT AS value, 'global_reference_resolution' AS name, 3::BIGINT AS tables FROM nation
""")
def reference_table(spark, sf_dir):
    """From pages to the table of resolved references: growth or revenue of a chart's or a table's row."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    page = F.concat(
        F.lit('[[{"type": "table", "content": {"title": "Plan", "periods": ["2024"], "rows": [{"label": "Growth yoy", "values": ["'), k, F.lit('"]}]}}, {"type": "chart", "content": {"title": "Sales chart", "periods": ["2024"], "series": [{"name": "Revenue", "values": ["'), (100 + F.col("n_nationkey")).cast("string"),
        F.lit('"]}]}}], [{"type": "text", "text": "As said for 2024, '), F.when(F.col("n_nationkey") % 2 == 0, "the growth").otherwise("this amount"), F.lit(' is large."}]]'),
    )
    t = structure.materialize_tables(artifacts.flatten_v2(n.select(F.col("n_nationkey").cast("long").alias("task_id"), page.alias("json"))))
    tables = t.tables.groupBy("task_id").agg(F.count("*").alias("tables"), F.max_by(F.struct("name", "table_seq"), "table_seq").alias("last")).select("task_id", "tables", "last.*")
    cells = t.cells.where("period = 'resolved_value'").join(t.rows.select("task_id", "table_seq", "row_seq", "item"), ["task_id", "table_seq", "row_seq"])
    return cells.join(tables, ["task_id", "table_seq"]).select(F.col("task_id").cast("int").alias("task_id"), "item", F.col("value").cast("long").alias("value"), "name", "tables")


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 5 AS k FROM customer)
SELECT id AS task_id, ['Rerun with OCR or remote VLM/hybrid backend to improve table recall.', 'Review failed sum checks and rerun affected pages with stricter parsing.', 'Apply numeric repair for OCR-confused digits and footnote markers.', 'Infer or confirm units from nearby paragraphs and table footnotes.', 'Infer or confirm period headers from multi-level table headers.'][k + 1] AS action,
  ['No structured tables were produced.', 'One or more numeric consistency checks failed.', '', 'At least one table is missing an explicit unit or scale.', 'At least one table is missing explicit period headers.'][k + 1] AS warning, CASE WHEN k < 2 THEN 'high' ELSE 'medium' END AS risk_level FROM c
""")
def quality_advice(spark, sf_dir):
    """One kind of fault a task: no tables, a failed sum, an unread number, no unit, no periods."""
    c = read(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "task_id")
    k = F.col("task_id") % 5
    some = c.where(k > 0)
    tables = some.select("task_id", F.lit(0).alias("table_seq"), F.lit("t").alias("name"), F.lit("T").alias("title"), F.when(k != 3, "USD").alias("unit"), F.lit("").alias("table_type"), F.when(k != 4, F.array(F.lit("p"))).otherwise(no_strings()).alias("periods"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    rows = some.select("task_id", F.lit(0).alias("table_seq"), F.posexplode(F.array(F.lit("Part"), F.lit("Total"))).alias("row_seq", "item"), F.lit(1).alias("page"), absent().alias("bbox")).withColumn("components", F.when((F.col("item") == "Total") & (k == 1), F.array(F.lit("part"))).otherwise(no_strings()))
    cells = rows.select("task_id", "table_seq", "row_seq", F.lit(0).alias("cell_index"), F.lit("p").alias("period"), F.when((k == 2) & (F.col("row_seq") == 0), "1O").otherwise((F.col("row_seq") + 5).cast("string")).alias("raw")).withColumn("value", T.parse_number("raw"))
    q = quality.quality(c.select("task_id"), quality.table_diagnostics(tables, rows, cells), quality.verify(tables, rows, cells))
    return q.select("task_id", F.array_join("recommended_actions", ";").alias("action"), F.array_join("warnings", ";").alias("warning"), "risk_level")


@query("SELECT o_orderpriority AS method, count(*) AS reports, CAST(sum(o_custkey) AS BIGINT) AS row_count, round(avg(CASE WHEN o_custkey % 2 = 0 THEN o_custkey END), 4) AS expectation_score FROM orders GROUP BY 1")
def method_rows(spark, sf_dir):
    """Lines of a benchmark, a task each, and their summary by method; missing scores don't count."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    nothing = {c: F.lit(0.0) for c in ("table_count", "failed_count", "warning_count", "validation_pass_rate", "numeric_parse_coverage", "evidence_coverage", "financial_table_count")}
    q = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("row_count"), "o_orderpriority").withColumns(nothing)
    scores = o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").cast("double").alias("score"), F.lit("pass").alias("status"), F.lit(1).alias("passed_count"), F.lit(1).alias("check_count"))
    lines = evaluate.method_row(q, scores, "m").drop("method").join(o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("method")), "task_id")
    return evaluate.method_summary(lines, ["row_count"], ["expectation_score"])
