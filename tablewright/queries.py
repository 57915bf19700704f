"""The query catalogue: each engine query over the driver's tables, with SQL that computes the same.

The SQL works from the undamaged source columns; the Spark side renders them as text, HTML or JSON
first and has to recover them through the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate, quality, reconcile, references, repair, structure
from .plans import routing, steps
from .session import dealt, stored
from .sources import artifacts, html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def money() -> F.Column:
    """The column of whole cents as text with two decimals."""
    return F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad(F.expr("cents % 100").cast("string"), 2, "0"))


def lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", *more).withColumn("cents", cents("l_extendedprice")).withColumn("plain", money())


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
PLAIN = f"CAST({CENTS} // 100 AS VARCHAR) || '.' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0')"


@query(f"""
SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 8 WHEN 6 THEN NULL WHEN 2 THEN -{CENTS} WHEN 3 THEN -{CENTS} ELSE {CENTS} END AS value_cents FROM lineitem
""")
def parse_number_formats(spark, sf_dir):
    df = lines(spark, sf_dir)
    k, p, c = (F.col("l_orderkey") + F.col("l_linenumber")) % 8, F.col("plain"), F.format_number(F.col("cents") / 100, 2)
    raw = F.when(k == 0, p).when(k == 1, c).when(k == 2, F.concat(F.lit("("), c, F.lit(")"))).when(k == 3, F.concat(F.lit("（"), p, F.lit(")"))).when(k == 4, F.concat(F.lit("RMB "), c)).when(k == 5, F.concat(p, F.lit("%"))).when(k == 6, "--").otherwise(F.concat(F.lit(" $ "), p, F.lit("*†")))
    return df.select("l_orderkey", "l_linenumber", F.round(T.parse_number(raw) * 100).cast("long").alias("value_cents"))


@query(f"""
SELECT CAST((l_orderkey + l_linenumber) % 6 AS BIGINT) AS k, count(*) AS n, count(*) FILTER ((l_orderkey + l_linenumber) % 6 IN (0, 1, 4)) AS n_like, count(*) FILTER ((l_orderkey + l_linenumber) % 6 IN (0, 1)) AS n_parsed FROM lineitem GROUP BY 1
""")
def numeric_like_profile(spark, sf_dir):
    df = lines(spark, sf_dir)
    k, p = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("plain")
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("USD "), p)).when(k == 2, F.concat(F.lit("Year ended Mar "), p)).when(k == 3, F.concat(F.lit("quarter "), p)).when(k == 4, F.concat(p, F.lit("lO"))).otherwise("none")
    g = df.select(k.alias("k"), T.looks_numeric(raw).alias("like"), T.parse_number(raw).isNotNull().alias("parsed"))
    return g.groupBy("k").agg(F.count("*").alias("n"), F.count_if("like").alias("n_like"), F.count_if(F.col("like") & F.col("parsed")).alias("n_parsed"))


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment AS clean FROM customer")
def normalize_text_ws(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return c.select("c_custkey", T.normalize_text(F.concat(F.lit("　 "), "c_name", F.lit("\t\n\x1f"), "c_mktsegment", F.lit("  "))).alias("clean"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') || '_' || replace(lower(p_type), ' ', '_') AS slug FROM part")
def slugify_names(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", T.slugify_name(F.concat(F.lit(" ("), F.upper("p_name"), F.lit(" -- "), "p_type", F.lit(")!"))).alias("slug"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'USD million' WHEN 2 THEN '人民币百万元' ELSE '' END AS unit, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS page_unit FROM nation
""")
def unit_extraction(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    k = F.col("n_nationkey") % 4
    said = F.when(k == 0, F.concat(F.lit("合并 单位： "), "n_name", F.lit("，币种"))).when(k == 1, F.concat(F.lit("In USD million for "), "n_name")).when(k == 2, "金额 人民币百万元。").otherwise(F.col("n_name"))
    page = F.when(k % 2 == 0, F.concat(F.lit("Totals Unit: "), "n_name", F.lit("； audited"))).otherwise("no marker")
    return n.select("n_nationkey", T.unit_from_text(said).alias("unit"), T.html_unit(page).alias("page_unit"))


@query("SELECT c_custkey, ['growth', 'rate', 'revenue', 'cash_flow', 'profit', 'amount'][c_custkey % 6 + 1] AS kind FROM customer")
def metric_kind_classify(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    labels = F.array(*[F.lit(x) for x in ("YoY sales of", "Gross MARGIN of", "Net sales of", "Cash flow of", "Operating 利润 of", "Total of")])
    label = F.concat_ws(" ", F.get(labels, F.col("c_custkey") % 6), "c_name")
    return c.select("c_custkey", T.metric_kind(label, F.lit("2024"), F.lit("Accounts")).alias("kind"))


@query("SELECT r_regionkey, r_name AS title, n_name AS item, 'Key' AS period, CAST(n_nationkey AS BIGINT) AS value FROM region JOIN nation ON n_regionkey = r_regionkey")
def html_grid_roundtrip(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    line = F.concat(F.lit("<tr><td> "), "n_name", F.lit("</td><td>&nbsp;"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    g = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    page = g.select("r_regionkey", F.concat(F.lit("<html><title>x</title><table><caption>"), "r_name", F.lit("</caption><tr><th>Nation</th><th>Key</th></tr>"), "body", F.lit("</table></html>")).alias("html"))
    t = html.html_tables(page, "r_regionkey")
    rows = structure.grid_rows(t, ["r_regionkey", "title"])
    cells = structure.row_cells(rows.withColumn("labels", F.col("periods")), ["r_regionkey", "title", "item"])
    return cells.select("r_regionkey", "title", "item", "period", F.col("value").cast("long").alias("value"))


@query("""
SELECT r_regionkey, 'Balance' AS item, r_name || ' ' || n_name AS period, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS value
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
""")
def html_rowspan_header(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c = read(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.sum(cents("c_acctbal")).alias("total"))
    each = n.join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    g = each.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_name", "total"))).alias("x"))
    cells = lambda tag, f: F.array_join(F.transform("x", lambda v: F.concat(F.lit(f"<{tag}>"), f(v), F.lit(f"</{tag}>"))), "")
    page = F.concat(F.lit("<table><tr><th rowspan=2>Item</th><th colspan="), F.size("x").cast("string"), F.lit(">"), "r_name", F.lit("</th></tr><tr>"), cells("th", lambda v: v["n_name"]), F.lit("</tr><tr><td>Balance</td>"), cells("td", lambda v: F.format_number(v["total"], 0)), F.lit("</tr></table>"))
    t = html.html_tables(g.select("r_regionkey", page.alias("html")), "r_regionkey")
    rows = structure.grid_rows(t, ["r_regionkey"])
    out = structure.row_cells(rows.withColumn("labels", F.col("periods")), ["r_regionkey", "item"])
    return out.select("r_regionkey", "item", "period", F.col("value").cast("long").alias("value"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\pZ]+', ' ', 'g')) AS title FROM pages
""")
def page_title_extract(spark, sf_dir):
    return html.page_titles(read(spark, sf_dir, "pages", "page_id", "html"), "page_id")


@query("SELECT l_orderkey AS task_id, CAST(l_linenumber % 3 AS INTEGER) AS page_idx, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY ALL")
def blocks_flatten_v2(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    block = F.struct((F.col("l_linenumber") % 3).alias("p"), F.struct(F.lit("Text ").alias("type"), F.col("l_partkey").cast("string").alias("text")).alias("b"))
    g = li.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.collect_list(block).alias("x"))
    pages = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.transform(F.filter("x", lambda v: v["p"] == p), lambda v: v["b"]))
    blocks = artifacts.flatten_v2(g.select("task_id", F.to_json(pages).alias("json")))
    return blocks.where("block_type = 'text'").groupBy("task_id", "page_idx").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("parts"))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN nullif(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS said FROM conversations
""")
def context_ffill(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    blocks = c.select(F.col("conv_id").alias("task_id"), F.lit(0).alias("page_idx"), F.col("turn").alias("block_seq"), F.lit(False).alias("is_table"), (F.col("role") == "user").alias("is_heading"), F.col("text").alias("heading_text"), F.lit("").alias("block_text"))
    return structure.carry_context(blocks, ["task_id"]).select(F.col("task_id").alias("conv_id"), F.col("block_seq").alias("turn"), F.col("context_title").alias("said"))


@query("""
WITH p AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS h FROM events),
o AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id, event_type ORDER BY h) <= 1 THEN 0 ELSE 1 END AS opens FROM p),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY h) AS run FROM o)
SELECT user_id AS task_id, event_type AS name, CAST(min(h) AS BIGINT) AS page_start, CAST(max(h) AS BIGINT) AS page_end, count(*) AS parts FROM r GROUP BY user_id, event_type, run
""")
def cross_page_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_type", "ts")
    hour = F.date_diff(F.to_date("ts"), F.lit("2024-01-01")) * 24 + F.hour("ts")
    pages = e.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("name"), hour.cast("long").alias("page_start")).distinct()
    t = structure.merge_islands(pages.withColumns({"table_seq": F.col("page_start"), "title": F.initcap("name")}))
    return t.groupBy("task_id", "name", "island").agg(F.min("page_start").alias("page_start"), F.max("page_start").alias("page_end"), F.count("*").alias("parts")).drop("island")


@query("SELECT user_id AS task_id, event_type AS label, max(event_id) AS row_seq FROM events GROUP BY ALL")
def row_index_last_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_type", "event_id")
    rows = e.select(F.col("user_id").alias("task_id"), F.lit(0).alias("table_seq"), F.upper("event_type").alias("item"), F.col("event_id").alias("row_seq"))
    return quality.row_index(rows).drop("table_seq")


def _statement(spark, sf_dir):
    """Each order as a table: a row for each line, and a total that is a cent too high in every seventh order."""
    from pyspark.sql import Window

    li = lines(spark, sf_dir, "l_partkey")
    li = dealt(li, li.count(), "l_orderkey")
    key = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "cents")
    each = li.select(F.col("l_orderkey").alias("task_id"), F.lit(0).alias("table_seq"), F.row_number().over(key).alias("row_seq"), "cents")
    rows = each.withColumns({"item": F.concat(F.lit("Line "), F.col("row_seq").cast("string")), "components": F.array().cast("array<string>")})
    total = rows.groupBy("task_id", "table_seq").agg(F.lit(0).alias("row_seq"), F.sum("cents").alias("cents"), F.lit("Total").alias("item"), F.collect_list(F.upper("item")).alias("components"))
    total = total.withColumn("cents", F.col("cents") + (F.col("task_id") % 7 == 0).cast("long"))
    every = stored(rows.select(*total.columns).union(total))
    return every, every.select("task_id", "table_seq", "row_seq", F.lit(0).alias("cell_index"), F.lit("price").alias("period"), F.col("cents").cast("string").alias("raw"), F.col("cents").cast("double").alias("value"))


@query("SELECT DISTINCT l_orderkey AS task_id, 'Total' AS total, CASE WHEN l_orderkey % 7 = 0 THEN 'fail' ELSE 'pass' END AS status FROM lineitem")
def component_sum_check(spark, sf_dir):
    rows, cells = _statement(spark, sf_dir)
    return quality.component_sums(rows, cells).select("task_id", F.col("row").alias("total"), "status")


@query(f"""
WITH l AS (SELECT l_orderkey, (l_orderkey + l_linenumber) % 11 = 0 AS odd FROM lineitem),
t AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n, count(*) FILTER (odd) AS n_odd FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL),
q AS (SELECT c_custkey AS task_id, count(o_orderkey) AS table_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, CAST(coalesce(sum(n - n_odd), 0) AS BIGINT) AS parsed, CAST(coalesce(sum(n_odd), 0) AS BIGINT) AS n_odd, coalesce(bool_or(o_orderkey % 3 = 0), false) AS no_unit FROM customer LEFT JOIN t ON o_custkey = c_custkey GROUP BY ALL)
SELECT task_id, table_count, row_count, row_count AS numeric_like_cell_count, parsed AS parsed_numeric_cell_count, CAST(n_odd + (table_count = 0)::INT + no_unit::INT AS BIGINT) AS warning_count, 0::BIGINT AS failed_count,
  CASE WHEN table_count = 0 THEN 'high' WHEN n_odd > 0 OR no_unit THEN 'medium' ELSE 'low' END AS risk_level FROM q
""")
def quality_rollup(spark, sf_dir):
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li = lines(spark, sf_dir, "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "cents"))
    each = li.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("table_seq"), seq.alias("row_seq"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0, F.concat("plain", F.lit("O,l"))).otherwise(F.col("plain")).alias("raw"))
    rows = each.withColumns({"item": F.lit("line"), "components": F.array().cast("array<string>"), "page": F.lit(1), "bbox": F.lit(None).cast("string")})
    cells = each.withColumns({"cell_index": F.lit(0), "period": F.lit("p"), "value": T.parse_number("raw")})
    tables = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("table_seq"), F.lit("orders").alias("name"), F.lit("Orders").alias("title"), F.when(F.col("o_orderkey") % 3 != 0, "USD").alias("unit"), F.lit("").alias("table_type"), F.array(F.lit("p")).alias("periods"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    d, c = quality.table_diagnostics(tables, rows, cells), quality.verify(tables, rows, cells)
    q = quality.quality(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")), d, c)
    return q.select("task_id", "table_count", "row_count", "numeric_like_cell_count", "parsed_numeric_cell_count", "warning_count", "failed_count", "risk_level")


@query("SELECT o_orderkey AS table_seq, 'table_presence' AS type, 'pass' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def table_presence_antijoin(spark, sf_dir):
    """Orders without lines pass as present; with lines the total is checked instead."""
    rows, cells = _statement(spark, sf_dir)
    tables = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(0).alias("table_seq"))
    return quality.verify(tables, rows, cells).where("type = 'table_presence'").select(F.col("task_id").alias("table_seq"), "type", "status")


@query(f"SELECT l_orderkey, l_linenumber, {CENTS} AS value_cents, 'ocr_digit_confusion' AS reason FROM lineitem WHERE regexp_matches({PLAIN}, '[01]') AND regexp_matches({PLAIN}, '[2-9]')")
def ocr_repair_digits(spark, sf_dir):
    df = repair.fixes(lines(spark, sf_dir), F.translate("plain", "01", "Ol"), F.lit("USD"))
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("fix.value") * 100).cast("long").alias("value_cents"), F.col("fix.reason").alias("reason"))


@query(f"SELECT l_orderkey, l_linenumber, {CENTS} AS value_cents, CASE WHEN l_linenumber % 3 = 2 THEN 'contextual_ocr_unit_suffix' ELSE 'contextual_unit_suffix' END AS reason FROM lineitem")
def unit_suffix_repair(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    damaged = F.when(k == 0, F.concat("plain", F.lit(" usd"))).when(k == 1, F.concat("plain", F.lit("百万元"))).otherwise(F.concat(F.lit("O"), "plain", F.lit(" 人民币")))
    df = repair.fixes(lines(spark, sf_dir), damaged, F.when(k == 0, "USD million").otherwise("单位 人民币百万元"))
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("fix.value") * 100).cast("long").alias("value_cents"), F.col("fix.reason").alias("reason"))


@query("SELECT c_custkey, CAST(72 + 4 * ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT) AS BIGINT) AS confidence FROM customer")
def repair_confidence(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey")
    used = F.array_compact(F.array(*[F.when(F.col("c_custkey") % d == 0, s) for d, s in [(2, "table_unit"), (3, "row_label"), (5, "peer_period_values"), (7, "period_header"), (11, "table_footnote")]]))
    return c.select("c_custkey", F.round(T.repair_confidence(used, repair.DIGIT_BASE) * 100).cast("long").alias("confidence"))


@query("""
WITH c AS (SELECT n_regionkey AS task_id, n_name, lower(c_mktsegment) AS s, 'P' || CAST(c_custkey % 30 AS VARCHAR) AS p FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT task_id, array_to_string(list_sort(list(DISTINCT n_name))[1:20], ',') AS units, array_to_string(list_sort(list(DISTINCT p))[1:20], ',') AS periods, count(DISTINCT s) AS metric_alias_count, array_to_string(list_sort(list(DISTINCT s))[1:20], ',') AS aliases FROM c GROUP BY task_id
""")
def shared_context(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tables = c.select(F.col("n_regionkey").alias("task_id"), F.col("n_name").alias("unit"), F.array().cast("array<string>").alias("periods")).distinct()
    rows = c.select(F.col("n_regionkey").alias("task_id"), F.col("c_mktsegment").alias("item"))
    cells = c.select(F.col("n_regionkey").alias("task_id"), F.concat(F.lit("P"), (F.col("c_custkey") % 30).cast("string")).alias("period"))
    s = reconcile.shared_context(tables, rows, cells)
    join = lambda x: F.array_join(x, ",")
    return s.select("task_id", join("units").alias("units"), join("periods").alias("periods"), "metric_alias_count", join("metric_alias_examples").alias("aliases"))


@query("""
WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY ALL),
b AS (SELECT *, CASE WHEN o_custkey % 5 = 0 THEN c // 20 ELSE CASE WHEN o_custkey % 5 = 1 THEN c // 200 ELSE 0 END END AS d FROM a)
SELECT o_custkey AS task_id, 'orders' AS metric, CAST(y AS VARCHAR) AS period, d <= greatest(1.0, (c + d) * 0.01::DOUBLE) AS matched, CAST(d AS BIGINT) AS delta FROM b
""")
def cross_file_reconcile(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    a = o.groupBy(F.col("o_custkey").alias("task_id"), F.year("o_orderdate").cast("string").alias("period")).agg(F.sum(cents("o_totalprice")).alias("c"))
    d = F.when(F.col("task_id") % 5 == 0, F.expr("c div 20")).when(F.col("task_id") % 5 == 1, F.expr("c div 200")).otherwise(0)
    sides = a.select("task_id", "period", F.explode(F.array(F.struct(F.lit("primary").alias("role"), F.col("c").cast("double").alias("value")), F.struct(F.lit("attachment").alias("role"), (F.col("c") + d).cast("double").alias("value")))).alias("s"))
    found = reconcile.reconcile(sides.select("task_id", F.lit(" Orders ").alias("metric"), "period", "s.role", "s.value"))
    return found.withColumn("delta", F.col("delta").cast("long"))


@query("""
WITH c AS (SELECT n_regionkey AS task_id, n_nationkey AS seq, ['growth', 'rate', 'revenue', 'cash_flow', 'profit', 'amount'][n_nationkey % 6 + 1] AS k, CAST(1990 + n_nationkey % 10 AS VARCHAR) AS per, n_nationkey % 7 AS page FROM nation),
m AS (SELECT c_custkey AS mention_id, c_nationkey % 5 AS task_id, ['growth', 'rate', 'revenue', 'cash_flow', 'amount'][c_custkey % 5 + 1] AS kind, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(1990 + c_custkey % 10 AS VARCHAR) END AS yr, c_custkey % 8 AS mp FROM customer),
s AS (SELECT m.task_id, mention_id, seq, page, (CASE WHEN k = kind THEN 600 WHEN kind = 'amount' AND k IN ('revenue', 'profit', 'cash_flow', 'amount') THEN 300 ELSE 0 END) + (CASE WHEN yr <> '' AND yr = per THEN 200 ELSE 0 END)
  + (CASE WHEN mp >= page THEN greatest(0, 200 - 35 * least(mp - page, 4)) ELSE -100 END) + (CASE WHEN c_.seq % 2 = 0 THEN 50 ELSE 0 END) AS score FROM m JOIN c c_ ON m.task_id = c_.task_id),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, mention_id ORDER BY score DESC, CASE WHEN page = 0 THEN -1 ELSE page END DESC, seq) AS n FROM s)
SELECT CAST(task_id AS BIGINT) AS task_id, mention_id, CAST(seq AS BIGINT) AS value, CAST(score AS BIGINT) AS score FROM r WHERE n = 1 AND score >= 300
""")
def top1_reference(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    kinds = F.array(*[F.lit(k) for k in ("growth", "rate", "revenue", "cash_flow", "profit", "amount")])
    label = F.when(F.col("n_nationkey") % 2 == 0, "The these of").otherwise("Account")
    cands = n.select(F.col("n_regionkey").cast("long").alias("task_id"), F.struct("n_nationkey").alias("cand_seq"), label.alias("label"), (1990 + F.col("n_nationkey") % 10).cast("string").alias("period"), F.col("n_nationkey").cast("double").alias("value"), (F.col("n_nationkey") % 7).alias("page"), F.get(kinds, F.col("n_nationkey") % 6).alias("metric_kind"))
    asked = F.array(*[F.lit(k) for k in ("growth", "rate", "revenue", "cash_flow", "amount")])
    mentions = c.select((F.col("c_nationkey") % 5).cast("long").alias("task_id"), F.col("c_custkey").alias("mention_id"), F.get(asked, F.col("c_custkey") % 5).alias("kind"), F.lit("the item").alias("phrase"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise((1990 + F.col("c_custkey") % 10).cast("string")).alias("year"), (F.col("c_custkey") % 8).alias("mention_page"))
    found = references.resolve(mentions, cands)
    return found.select("task_id", "mention_id", F.col("value").cast("long").alias("value"), F.round(F.col("score") * 100).cast("long").alias("score"))


@query(f"""
WITH v AS (SELECT l_suppkey, CAST(sum({CENTS}) AS BIGINT) AS c FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) = 1997 GROUP BY 1)
SELECT s_suppkey AS metric_id, CASE WHEN s_suppkey % 3 <> 0 THEN c END AS observed, CASE WHEN c IS NOT NULL AND s_suppkey % 3 <> 0 AND (s_suppkey % 4 <> 0 OR s_suppkey % 8 <> 0) THEN 'pass' ELSE 'fail' END AS status FROM supplier LEFT JOIN v ON l_suppkey = s_suppkey
""")
def required_metric_eval(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    g = li.groupBy(F.col("l_suppkey").alias("task_id"), F.concat(F.lit("Flag "), "l_returnflag", F.lit(" items")).alias("item"), F.year("l_shipdate").cast("string").alias("period")).agg(F.sum(cents("l_extendedprice")).cast("double").alias("value"))
    cells = g.select("task_id", F.lit("supply_table").alias("table"), F.lit("Supply").alias("title"), F.lit("USD cents").alias("unit"), "item", "period", "value", (F.col("task_id") % 8 != 0).alias("has_evidence"), F.struct("item", "period").alias("seq"))
    want = g.where("item = 'Flag R items' and period = '1997'").select("task_id", "value")
    m = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id")).join(want, "task_id", "left").select(
        "task_id", F.col("task_id").alias("metric_id"), F.lit("SUPPLY").alias("table_contains"), F.lit("flag r").alias("row_contains"), F.lit("usd").alias("unit_contains"), F.lit("1997").alias("period"),
        (F.col("value") + F.when(F.col("task_id") % 3 == 0, 10.0).otherwise(0.5)).alias("expected_value"), F.lit(1.0).alias("tolerance"), (F.col("task_id") % 4 == 0).alias("evidence_required"),
    )
    return evaluate.required_metrics(cells, m).withColumn("observed", F.col("observed").cast("long"))


@query("""
WITH e AS (SELECT p_size, p_brand FROM part WHERE p_partkey % 2 = 0), o AS (SELECT p_size, p_brand FROM part WHERE p_partkey % 3 = 0),
h AS (SELECT p_size, count(*) AS n_expected, count(*) FILTER ((p_size, p_brand) IN (SELECT (p_size, p_brand) FROM o)) AS matched FROM e GROUP BY p_size),
n AS (SELECT p_size, count(*) AS n_observed FROM o GROUP BY p_size)
SELECT h.p_size, matched, n_expected, coalesce(n_observed, 0) AS n_observed, CASE WHEN coalesce(n_observed, 0) > 0 THEN round(matched / n_observed, 4) ELSE 1.0 END AS precision, round(matched / n_expected, 4) AS recall FROM h LEFT JOIN n USING (p_size)
""")
def layout_accuracy(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    return evaluate.set_match(p.where("p_partkey % 2 = 0").drop("p_partkey"), p.where("p_partkey % 3 = 0").drop("p_partkey"), "p_size", "p_brand")


@query("""
WITH s AS (SELECT o_orderpriority AS method, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, round(avg(CAST(round(o_totalprice * 100) AS BIGINT)), 4) AS mean FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1)
SELECT CAST(a.n - b.n AS BIGINT) AS reports, CAST(a.cents - b.cents AS BIGINT) AS cents, round(a.mean - b.mean, 4) AS mean FROM s a, s b WHERE a.method = '1-URGENT' AND b.method = '5-LOW'
""")
def method_delta(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    reports = o.select(F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 10 == 0).alias("skipped"), cents("o_totalprice").alias("cents"), cents("o_totalprice").alias("mean"))
    s = evaluate.method_summary(reports, ["cents"], ["mean"])
    return evaluate.method_delta(s, "1-URGENT", "5-LOW", ["reports", "cents", "mean"])


@query("""
WITH v AS (SELECT event_type, list_sort(list(CAST(round(value * 100) AS BIGINT))) AS x FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, CAST(len(x) AS BIGINT) AS n, x[1] AS least, CAST(list_median(x) AS DOUBLE) AS median, round(list_avg(x), 4) AS mean, x[CAST(round_even((len(x) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1] AS p95, x[-1] AS most FROM v
""")
def soak_stats(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "value").withColumn("value", cents("value"))
    return evaluate.soak_stats(e, "event_type", "value")


@query("""
SELECT 'R' || r_regionkey AS name, 0 AS level FROM region UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation UNION ALL SELECT 'C' || c_custkey, 2 FROM customer UNION ALL SELECT 'S' || s_suppkey, 2 FROM supplier
""")
def plan_levels(spark, sf_dir):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    none = F.array().cast("array<string>")
    r = read(spark, sf_dir, "region").select(tag("R", "r_regionkey").alias("name"), none.alias("depends_on"))
    n = read(spark, sf_dir, "nation").select(tag("N", "n_nationkey"), F.array(tag("R", "n_regionkey")))
    c = read(spark, sf_dir, "customer").select(tag("C", "c_custkey"), F.array(tag("N", "c_nationkey")))
    s = read(spark, sf_dir, "supplier").select(tag("S", "s_suppkey"), F.array(tag("N", "s_nationkey")))
    plan = r.union(n).union(c).union(s).withColumn("task_id", F.lit(0))
    return steps.plan_levels(plan, steps.edges_of(plan)).select("name", "level")


@query("""
WITH s AS (SELECT p_partkey, least(p_size, p_size + p_partkey % 30 - 5) AS lo, greatest(p_size, p_size + p_partkey % 30 - 5) AS hi FROM part)
SELECT p_partkey, CAST(unnest(CASE WHEN hi - lo > 20 THEN [lo, hi] ELSE range(lo, hi + 1) END) AS INTEGER) AS page FROM s
""")
def page_range_expand(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_size")
    end = (F.col("p_size") + F.col("p_partkey") % 30 - 5).cast("int")
    return p.select("p_partkey", F.explode(routing.page_range(F.col("p_size"), end)).alias("page"))


@query("""
SELECT o_custkey AS task_id, o_orderkey AS table_seq, 'original' AS kind FROM orders WHERE o_custkey % 4 <> 0 OR o_orderkey % 10 >= 3 AND o_orderkey % 10 < 9 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 6 = 0)
UNION ALL SELECT o_custkey, o_orderkey, 'retried' FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 6 = 0
""")
def targeted_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("table_seq"))
    page = (F.col("table_seq") % 10).cast("int")
    original = o.select("task_id", "table_seq", F.lit("original").alias("kind"), F.array(page, ((page + 1) % 10).cast("int")).alias("pages"))
    retried = original.where("task_id % 4 = 0 and table_seq % 6 = 0").withColumn("kind", F.lit("retried"))
    targets = o.select("task_id").distinct().withColumn("page", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return routing.merge_targeted(original, retried, targets).select("task_id", "table_seq", "kind")


@query("""
SELECT c_custkey, ['missing_input', 'model_cache_unavailable', 'model_config_missing', 'resource_exhausted', 'remote_backend_unavailable', 'timeout', 'parser_cli_failed', 'unknown_parse_failure'][c_custkey % 8 + 1] AS category, c_custkey % 8 <> 0 AS recoverable, c_custkey % 8 = 0 AS terminal FROM customer
""")
def failure_classify(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey") % 8
    err = F.array(*[F.lit(x) for x in ("", "LocalEntryNotFoundError: x", "models_download_utils: 'NoneType' object has no attribute 'get'", "CUDA out of memory", "Connection refused", "request Timed Out", "bad flag", "odd")])
    kind = routing.classify_failure(F.when(k == 0, "missing_input").otherwise("failed"), F.col("c_name"), F.lit(None).cast("string"), F.get(err, k), F.when(k == 6, 2).otherwise(0))
    return c.select("c_custkey", kind.alias("f")).select("c_custkey", "f.*")


@query("""
SELECT c_custkey AS task_id, ['ocr_first', 'native_html_table_parse', 'office_attachment_expansion', 'sample_then_full_text', 'text_first_with_quality_recovery', 'generic_document_parse'][k + 1] AS parse_strategy,
  ['pipeline', 'native_html', 'native_or_parser', 'pipeline', 'pipeline', 'native_or_parser'][k + 1] AS recommended_backend, ['ocr', 'html_table', NULL, 'txt', 'txt', NULL][k + 1] AS recommended_method, k = 3 AS large_document_hint FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)
""")
def route_profile(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey") % 6
    ends = F.array(*[F.lit(x) for x in ("photo.PNG", "page.htm", "book.xlsx", "full.pdf", "note.pdf", "data.bin")])
    tasks = c.select(F.col("c_custkey").alias("task_id"), F.lit("filing").alias("task_name"), F.when(k == 3, "annual_report").otherwise("report").alias("document_type"), F.lit("extract").alias("goal"))
    inputs = c.select(F.col("c_custkey").alias("task_id"), F.lit(0).alias("input_index"), F.concat(F.lit("/d.v1/"), F.get(ends, k)).alias("path"), F.lit(None).cast("string").alias("url"), F.lit("primary").alias("role"), F.lit(None).cast("string").alias("mime_type"), F.lit("filing").alias("task_name"), F.lit("report").alias("document_type"), F.lit(1.0).alias("size_mb"))
    p = routing.document_profiles(tasks, routing.input_signals(inputs))
    return p.select("task_id", "parse_strategy", "recommended_backend", "recommended_method", "large_document_hint")


@query("""
WITH o AS (SELECT c_custkey AS task_id, [NULL, 'pipeline', 'hybrid-http-client'][c_custkey % 3 + 1] AS b, ['txt', 'ocr'][c_custkey % 2 + 1] AS m, CASE WHEN c_custkey % 5 = 0 THEN 'http://x' END AS s FROM customer)
SELECT task_id, 0 AS rank, b AS backend, m AS method, s AS server_url FROM o
UNION ALL SELECT task_id, 1, 'pipeline', 'ocr', s FROM o WHERE coalesce(b, 'pipeline') = 'pipeline' AND m <> 'ocr'
UNION ALL SELECT task_id, 2, 'hybrid-http-client', m, s FROM o WHERE s IS NOT NULL AND coalesce(b, '') <> 'hybrid-http-client'
UNION ALL SELECT task_id, 3, 'pipeline', m, NULL FROM o WHERE b = 'hybrid-http-client'
""")
def attempt_dedupe(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    options = c.select(k.alias("task_id"), F.lit(0).alias("input_index"), F.lit(".pdf").alias("suffix"), F.when(k % 3 == 1, "pipeline").when(k % 3 == 2, "hybrid-http-client").alias("backend"), F.when(k % 2 == 0, "txt").otherwise("ocr").alias("method"), F.when(k % 5 == 0, "http://x").alias("server_url"), F.lit(True).alias("auto_recovery"))
    tries = routing.attempts(options)
    twice = routing.dedupe_options(tries.union(tries), ["backend", "method", "server_url", "reason"], "attempt")
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("retry_with_ocr", 1, "retry_with_remote_hybrid", 2, "retry_with_local_pipeline", 3)]), F.coalesce("reason", F.lit("base"))), F.lit(0))
    return twice.select("task_id", rank.alias("rank"), "backend", "method", "server_url")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Annual revenue' ELSE 'Operating income' END AS item, CAST(round(o_totalprice) AS BIGINT) AS amount, CAST(o_orderkey % 90 AS BIGINT) AS change FROM orders WHERE o_orderkey % 3 <> 0
""")
def narrative_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    what = F.when(F.col("o_orderkey") % 2 == 0, "annual revenue").otherwise("operating income")
    said = F.concat(F.lit("We had approximately $"), F.round("o_totalprice").cast("long").cast("string"), F.lit(" Billon in "), what, F.when(F.col("o_orderkey") % 3 != 0, F.lit(", increased ")).otherwise(F.lit(", down ")), (F.col("o_orderkey") % 90).cast("string"), F.lit(" percent"))
    found = structure.narrative_metrics(o.select("o_orderkey", said.alias("block_text")))
    return found.select("o_orderkey", "item", F.col("amount").cast("long").alias("amount"), F.col("change").cast("long").alias("change"))


@query("""
WITH y AS (SELECT o_custkey AS task_id, CAST(year(o_orderdate) AS VARCHAR) AS period, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY ALL)
SELECT task_id, 'Orders' AS item, period, CAST(c AS BIGINT) AS value FROM y UNION ALL SELECT task_id, 'Peak', 'annotation_value', CAST(max(c) AS BIGINT) FROM y GROUP BY task_id
""")
def chart_series_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    y = o.groupBy(F.col("o_custkey").alias("task_id"), F.year("o_orderdate").cast("string").alias("p")).agg(F.sum(cents("o_totalprice")).alias("c"))
    g = y.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("p", "c"))).alias("x"), F.max("c").alias("peak"))
    content = F.struct(F.lit("bar").alias("chart_type"), F.transform("x", lambda v: v["p"]).alias("x_axis"), F.array(F.struct(F.lit("Orders").alias("name"), F.transform("x", lambda v: F.format_number(v["c"], 0)).alias("data"))).alias("series"), F.struct(F.lit("Peak").alias("label"), F.lit(0).alias("value"), F.col("peak").alias("amount")).alias("annotations"))
    blocks = g.select("task_id", F.lit(0).cast("long").alias("block_seq"), F.lit(1).alias("page_idx"), F.lit("chart").alias("block_type"), F.lit(None).cast("string").alias("bbox"), F.parse_json(F.to_json(content)).alias("content"), F.lit("Orders by year").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("context_unit"))
    t = structure.chart_tables(structure.classify(blocks))
    return t.cells.join(t.rows.select("task_id", "table_seq", "row_seq", "item"), ["task_id", "table_seq", "row_seq"]).select("task_id", "item", "period", F.col("value").cast("long").alias("value"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('error', 'view') AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def trace_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_id", F.col("event_type").alias("stage"), F.lit("step").alias("event_type"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return artifacts.filter_trace(e, ["error", "view"], ["step"]).where("k > 50").select("event_id", "k")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import task_queries  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import task_queries  # noqa: F401

    return dict(ORACLES)
