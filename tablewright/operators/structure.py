"""From blocks to normalised tables: long-form ``tables``, ``rows`` and ``cells``.

Keys: (task_id, table_seq), then row_seq, then cell_index. The period axis is data, not schema. Windows
and joins are by task_id, so many tasks run in one job. By default tables of different inputs don't share
context or merge; ``parity=True`` treats all inputs of a task as one list of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import extract_text
from ..functions.text import first_text, let, normalize_text, parse_cell, parse_number, slugify_name, unit_from_text
from ..session import checkpointed, stored

# Fixed values.
TABLE_TYPES = ["table", "simple_table", "complex_table"]
CHART_TYPES = ["chart", "figure_chart", "complex_chart", "plot"]
HEADING_TYPES = ["title", "doc_title", "paragraph_title"]
NARRATIVES = [("Annual revenue", "annual", "revenue"), ("Operating income", "operating", "income")]
# End of fixed values.


@dataclass
class Tables:
    """tables (task_id, table_seq, name, title, unit, ...), rows (..., row_seq, item, ...), cells (..., cell_index, period, raw, value).

    ``nested``, if there, is the same with a row a table (see :func:`nested`), so that no join is needed to bring the three together.
    """

    tables: DataFrame
    rows: DataFrame
    cells: DataFrame
    nested: DataFrame | None = None


def _get(path: str, kind: str = "variant", of: str = "content") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def _input(d: DataFrame) -> list[str]:
    """The column that tells a task's inputs apart, if there is one."""
    return ["input_index"] if "input_index" in d.columns else []


def _has(*keys: str) -> Column:
    found = F.lit(False)
    for k in keys:
        found = found | _get(k).isNotNull()
    return F.coalesce(found, F.lit(False))


def classify(blocks: DataFrame) -> DataFrame:
    """``blocks`` with is_table, is_chart and is_heading; a block may be a table and a chart."""
    kind = F.lower(normalize_text("block_type"))
    return blocks.withColumns({
        "is_table": kind.isin(*TABLE_TYPES) | _has("rows", "table_rows", "headers", "html"),
        "is_chart": kind.isin(*CHART_TYPES) | _has("chart_type", "series", "annotations"),
        "is_heading": kind.isin(*HEADING_TYPES),
    })


def block_texts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with block_text and heading_text, by precedence of the content's keys."""
    is_object = F.schema_of_variant("content").startswith("OBJECT")
    any_text = lambda *keys: F.coalesce(*[F.nullif(extract_text(_get(k)), F.lit("")) for k in keys])
    plain = first_text(F.when(~is_object, extract_text("content")), "text", "title")
    return blocks.withColumns({
        "block_text": F.when(is_object, F.coalesce(any_text("paragraph_content", "title_content", "page_footnote_content"), extract_text("content"))).otherwise(plain),
        "heading_text": F.when(is_object, F.coalesce(any_text("title_content", "paragraph_content"), F.lit(""))).otherwise(plain),
    })


def carry_context(blocks: DataFrame, scope: list[str]) -> DataFrame:
    """``blocks`` with context_title and context_unit: the last heading and unit of the page so far."""
    so_far = Window.partitionBy(*scope, "page_idx").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unit = F.when(~F.col("is_table"), F.nullif(unit_from_text("block_text"), F.lit("")))
    title = F.when(F.col("is_heading"), F.nullif(F.col("heading_text"), F.lit("")))
    return blocks.withColumns({"context_unit": F.last(unit, ignorenulls=True).over(so_far), "context_title": F.last(title, ignorenulls=True).over(so_far)})


def body_start(grid: Column) -> Column:
    """Index of the first grid row with a number right of column 0; else 1, or 0 for a single row."""
    numeric = F.transform(grid, lambda row: F.exists(F.slice(row, F.lit(2), F.greatest(F.size(row), F.lit(1))), lambda x: parse_number(x).isNotNull()))
    first = F.array_position(numeric, True)
    return F.when(first > 0, first - 1).otherwise(F.when(F.size(grid) > 1, 1).otherwise(0)).cast("int")


def header_periods(grid: Column, headers: Column, n: Column) -> Column:
    """Labels of columns 1..n: the distinct texts of the header rows in order; ``col_i`` (from 0) where they are blank."""
    column = lambda c: F.array_distinct(F.filter(F.transform(F.slice(grid, F.lit(1), headers), lambda row: normalize_text(F.get(row, c))), lambda x: x != ""))
    label = lambda c: F.coalesce(F.nullif(F.array_join(column(c), " "), F.lit("")), F.concat(F.lit("col_"), (c - 1).cast("string")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), label)).otherwise(F.array().cast("array<string>"))


def grid_rows(grids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, periods, row_seq, item, raws of tables given as ``grid`` (array of rows of texts)."""
    headers = F.greatest(body_start(F.col("grid")), F.lit(1))
    cut = grids.withColumn("headers", headers).withColumn("body", F.slice("grid", F.col("headers") + 1, F.greatest(F.size("grid"), F.lit(1))))
    widest = F.coalesce(F.array_max(F.transform("body", lambda row: F.size(row) - 1)), F.lit(0))
    labelled = cut.withColumn("periods", header_periods(F.col("grid"), F.col("headers"), widest))
    lines = labelled.select(*keys, "periods", F.posexplode("body").alias("row_seq", "line"))
    told = F.exists("line", lambda x: normalize_text(x) != "")
    return lines.where(told).select(*keys, "periods", "row_seq", normalize_text(F.get("line", F.lit(0))).alias("item"), F.transform(F.slice("line", F.lit(2), F.greatest(F.size("line"), F.lit(1))), normalize_text).alias("raws"))


def row_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_seq, cell_index, period, raw, value from rows with ``raws`` and ``labels`` (periods of that row)."""
    cells = rows.select(*keys, "row_seq", "labels", F.posexplode("raws").alias("cell_index", "raw"))
    period = F.coalesce(F.get("labels", F.col("cell_index")), F.concat(F.lit("col_"), F.col("cell_index").cast("string")))
    return cells.select(*keys, "row_seq", "cell_index", period.alias("period"), "raw", parse_number("raw").alias("value"))


def _lines(rows: Column) -> Column:
    """The rows of a variant (an array, or an object's values in the order of its keys) that are objects: array<struct<row_seq, item, row_type, components, own_page, raws>>."""
    given = F.coalesce(F.try_variant_get(rows, "$", "array<variant>"), F.map_values(F.try_variant_get(rows, "$", "map<string,variant>")))

    names = ["label", "item", "name", "text", "row_type", "components", "page_idx", "values", "cells", "data"]

    def line(row: Column, at: Column) -> Column:
        # One pass over the object's fields; null unless it is an object.
        fields = F.try_variant_get(row, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")
        return let(fields, lambda f: F.when(f.isNotNull(), line_of(f, at)))

    def line_of(f: Column, at: Column) -> Column:
        got = lambda k, kind: F.try_variant_get(f[k], "$", kind)
        told = lambda k: F.when(f[k].isNotNull(), let(normalize_text(got(k, "string")), lambda t: F.when(t != "", t)))
        of = lambda otherwise, *ks: F.coalesce(*map(told, ks), F.lit(otherwise))
        texts = lambda *ks: F.coalesce(*[F.when(f[k].isNotNull(), got(k, "array<string>")) for k in ks], F.array().cast("array<string>"))
        return F.struct(
            at.alias("row_seq"), of("", "label", "item", "name", "text").alias("item"), of("line", "row_type").alias("row_type"),
            F.transform(texts("components"), normalize_text).alias("components"), got("page_idx", "int").alias("own_page"), texts("values", "cells", "data").alias("raws"),
        )

    return F.array_compact(F.transform(given, line))


def normalize_tables(blocks: DataFrame) -> Tables:
    """Table blocks with context (see :func:`carry_context`) as tables, rows and cells; table_seq is block_seq.

    Tables are read from the blocks once and stored with their lines; rows and cells are unfolded from there.
    """
    from .html_grid import first_grid

    keys = ["task_id", "table_seq"]
    text = lambda k: F.coalesce(_get(k, "string"), F.lit(""))
    src = blocks.where("is_table").withColumn("table_seq", F.col("block_seq"))
    title = first_text(text("title"), text("caption"), text("table_caption"), "context_title", "title", "text")
    fallback = F.concat(F.lit("table_"), F.coalesce("page_idx", F.lit(0)).cast("string"))
    named = src.withColumns({
        "title_text": title,
        "unit": first_text(text("unit"), text("currency"), text("scale"), "context_unit"),
        "html": _get("html", "string"),
        "declared": F.filter(F.coalesce(_get("periods", "array<string>"), F.slice(F.element_at(_get("headers", "array<array<string>>"), -1), F.lit(2), F.lit(1 << 20)), F.array().cast("array<string>")), lambda p: normalize_text(p) != ""),
    })
    named = named.withColumn("name", slugify_name(F.coalesce(F.nullif(F.col("title_text"), F.lit("")), text("name"), fallback)))
    role = F.coalesce(F.nullif(normalize_text("role"), F.lit("")), F.lit("unknown")) if "role" in blocks.columns else F.lit("unknown")
    base = stored(named.select(
        *keys, *_input(blocks), "name", F.coalesce(F.nullif(F.col("title_text"), F.lit("")), F.col("name")).alias("title"), "unit", normalize_text(_get("table_type", "string")).alias("table_type"),
        F.coalesce(_get("table_footnote", "string"), F.lit("")).alias("footnote"), F.when(F.schema_of_variant(_get("table_footnote")) != "STRING", F.to_json(_get("table_footnote"))).alias("footnote_json"), "declared", "page_idx", "bbox", role.alias("role"), "html", F.when(F.col("html").isNull(), _lines(F.coalesce(_get("rows"), _get("table_rows")))).alias("lines"),
    ))
    has_html, has_footnotes = base.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)) for c in ("html", "footnote_json")]).first()
    footnote = normalize_text("footnote")
    if has_footnotes:
        footnote = F.when(F.col("footnote_json").isNotNull(), extract_text(F.parse_json("footnote_json"))).otherwise(footnote)
    plain, drawn = base.where("html is null"), base.where("html is not null")
    head = lambda d, periods: d.select(*keys, "name", "title", "unit", "table_type", footnote.alias("footnote"), periods.alias("periods"), *_input(blocks), F.col("page_idx").alias("page_start"), F.col("page_idx").alias("page_end"), "bbox", "role")
    tables, kept = head(plain, F.col("declared")), ["row_seq", "item", "row_type", "components", "page", "bbox"]
    lines = plain.select(*keys, "page_idx", "bbox", F.explode("lines").alias("l")).select(*keys, "page_idx", "bbox", "l.*")
    rows = lines.withColumn("page", F.coalesce("own_page", "page_idx")).select(*keys, *kept)
    whole = plain.select(*keys, "name", "title", "unit", "role", F.col("page_idx").alias("page_start"), F.col("bbox").alias("table_bbox"), F.transform("lines", lambda x: F.struct(x["row_seq"].alias("row_seq"), x["item"].alias("item"), F.coalesce(x["own_page"], "page_idx").alias("page"), F.col("bbox").alias("bbox"), x["row_type"].alias("row_type"), x["raws"].alias("raws"), F.when((F.size("declared") > 0) & (F.size("declared") == F.size(x["raws"])), F.col("declared")).alias("labels"))).alias("lines"))
    cells = unfolded(lines_of(whole)).select(*keys, "row_seq", "cell_index", "period", "raw", "value")
    if has_html:
        grids = stored(drawn.drop("lines").withColumn("grid", first_grid("html")).drop("html"))
        from_html = grid_rows(grids, [*keys, "page_idx", "bbox"])
        inferred = from_html.groupBy(*keys).agg(F.first("periods").alias("inferred"))
        tables = tables.unionByName(head(grids.join(inferred, keys, "left"), F.when(F.size("inferred") > 0, F.col("inferred")).otherwise(F.col("declared"))))
        rows = rows.unionByName(from_html.select(*keys, "row_seq", "item", F.lit("line").alias("row_type"), F.array().cast("array<string>").alias("components"), F.col("page_idx").alias("page"), "bbox"))
        cells = cells.unionByName(row_cells(from_html.withColumn("labels", F.col("periods")), keys))
    return Tables(tables, rows, cells, None if has_html else whole)


def nested(t: Tables) -> DataFrame:
    """A row a table: task_id, table_seq, name, title, unit, role, page_start, table_bbox and lines, an array of rows (row_seq, item, page, bbox, row_type) that :func:`cells_of` takes."""
    if t.nested is not None:
        return t.nested
    table, row = ["task_id", "table_seq"], ["task_id", "table_seq", "row_seq"]
    cells = t.cells.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("cell_index", "period", "raw", "value"))).alias("cells"))
    line = F.struct("row_seq", "item", "page", "bbox", "row_type", F.coalesce("cells", F.array().cast("array<struct<cell_index:int,period:string,raw:string,value:double>>")).alias("cells"))
    lines = t.rows.join(cells, row, "left").groupBy(*table).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    of = t.tables.select(*table, "name", "title", "unit", "role", "page_start", F.col("bbox").alias("table_bbox"))
    return of.join(lines, table, "left")


def cells_of(line: Column, whole: DataFrame) -> Column:
    """The cells of a line of :func:`nested`: array<struct<cell_index, period, raw, value>>."""
    if "cells" in whole.schema["lines"].dataType.elementType.names:
        return line["cells"]
    return F.transform(line["raws"], lambda raw, i: F.struct(i.alias("cell_index"), F.coalesce(F.get(line["labels"], i), i.cast("string")).alias("period"), raw.alias("raw"), parse_cell(raw).alias("value")))


def lines_of(whole: DataFrame) -> DataFrame:
    """The rows of :func:`nested` with any other columns that ``whole`` has."""
    rest = [c for c in whole.columns if c != "lines"]
    return whole.select(*rest, F.explode("lines").alias("line")).select(*rest, "line.*")


def unfolded(lines: DataFrame) -> DataFrame:
    """The cells of :func:`lines_of` with the other columns of ``lines``, and is_last: is a cell the last of its row with its period?"""
    rest = [c for c in lines.columns if c not in ("raws", "labels", "cells")]
    if "cells" in lines.columns:
        later = F.transform(F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c["period"])
        return lines.select(*rest, "cells", F.posexplode("cells").alias("at", "cell")).select(*rest, "cell.*", (~F.array_contains(later, F.col("cell.period"))).alias("is_last"))
    each = lines.select(*rest, "labels", (F.size(F.array_distinct("labels")) < F.size("labels")).alias("repeated"), F.posexplode("raws").alias("cell_index", "raw"))
    later = F.slice("labels", F.col("cell_index") + 2, F.greatest(F.size("labels"), F.lit(1)))
    is_last = F.when(F.col("repeated"), ~F.array_contains(later, F.get("labels", F.col("cell_index")))).otherwise(True)
    return each.select(*rest, "cell_index", F.coalesce(F.get("labels", F.col("cell_index")), F.col("cell_index").cast("string")).alias("period"), "raw", parse_number("raw").alias("value"), is_last.alias("is_last"))


def merge_islands(tables: DataFrame) -> DataFrame:
    """``tables`` with island: the table_seq of the table that each merges into (itself if none).

    In order of page (null as 0) and table_seq, a table joins the one before of its name if the titles agree
    without case and its page is at most one behind; a null page never joins. Where ``tables`` has
    input_index, tables of different inputs stay apart.
    """
    part = ["task_id", *_input(tables), "name"]
    order = Window.partitionBy(*part).orderBy(F.coalesce("page_start", F.lit(0)), "table_seq")
    title = F.lower(normalize_text("title"))
    joins = (title != "") & (title == F.lag(title).over(order)) & (F.col("page_start") - F.lag("page_start").over(order) <= 1)
    opened = tables.withColumn("opens", (~F.coalesce(joins, F.lit(False))).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(order))
    first = F.first("table_seq").over(Window.partitionBy(*part, "run").orderBy(F.coalesce("page_start", F.lit(0)), "table_seq"))
    return numbered.withColumn("island", first).drop("opens", "run")


def merge_cross_page(t: Tables) -> Tables:
    """Continuations take the key of the table they continue; its rows are numbered on, its periods and unit stay."""
    islands = merge_islands(t.tables)
    span = Window.partitionBy("task_id", "island")
    tables = islands.withColumn("page_end", F.max("page_end").over(span)).where("table_seq = island").drop("island")
    keys = islands.select("task_id", "table_seq", "island", F.coalesce("page_start", F.lit(0)).alias("at"))
    numbered = t.rows.join(keys, ["task_id", "table_seq"])
    order = Window.partitionBy("task_id", "island").orderBy("at", "table_seq", "row_seq")
    moved = numbered.withColumn("new_seq", (F.row_number().over(order) - 1).cast("int"))
    rows = moved.select("task_id", F.col("island").alias("table_seq"), F.col("new_seq").alias("row_seq"), *[c for c in t.rows.columns if c not in ("task_id", "table_seq", "row_seq")])
    to = moved.select("task_id", "table_seq", "row_seq", "island", "new_seq")
    cells = t.cells.join(to, ["task_id", "table_seq", "row_seq"]).select("task_id", F.col("island").alias("table_seq"), F.col("new_seq").alias("row_seq"), "cell_index", "period", "raw", "value")
    return Tables(tables, rows, cells)


def chart_tables(blocks: DataFrame) -> Tables:
    """Chart blocks as tables: series rows, then annotation rows; charts without rows are dropped. table_seq is block_seq."""
    keys = ["task_id", "table_seq"]
    src = blocks.where("is_chart").withColumn("table_seq", F.col("block_seq"))
    text = lambda k: F.coalesce(_get(k, "string"), F.lit(""))
    axis = F.filter(F.coalesce(*[_get(k, "array<string>") for k in ("periods", "x_axis", "categories")], F.array().cast("array<string>")), lambda p: normalize_text(p) != "")
    named = src.withColumns({"title_text": first_text(text("title"), text("caption"), "title", "text"), "chart_type": first_text(_get("chart_type", "string"), F.lit("chart")), "unit": F.coalesce(F.nullif(first_text(text("unit"), text("value_unit"), text("y_axis_unit"), "context_unit"), F.lit("")), F.lit("mixed")), "axis": axis})
    base = named.select(*keys, "content", "axis", "chart_type", "page_idx")
    listed = lambda k: f"CASE WHEN schema_of_variant(try_variant_get(s.content, '$.{k}', 'variant')) LIKE 'OBJECT%' THEN parse_json(concat('[', to_json(try_variant_get(s.content, '$.{k}', 'variant')), ']')) ELSE try_variant_get(s.content, '$.{k}', 'variant') END"
    series = base.sparkSession.sql(f"SELECT s.task_id, s.table_seq, s.axis, s.chart_type, s.page_idx, r.pos, r.value AS row FROM {{s}} s, LATERAL variant_explode({listed('series')}) r", s=base)
    notes = base.sparkSession.sql(f"SELECT s.task_id, s.table_seq, s.page_idx, r.pos, r.value AS row FROM {{s}} s, LATERAL variant_explode({listed('annotations')}) r", s=base)
    of = lambda *ks: first_text(*[_get(k, "string", "row") for k in ks])
    values = F.coalesce(_get("values", "variant", "row"), _get("data", "variant", "row"))
    as_list, as_map = F.try_variant_get(values, "$", "array<string>"), F.try_variant_get(values, "$", "map<string,string>")
    one = F.try_variant_get(values, "$", "string")
    by_axis = F.filter(F.transform("axis", lambda p: F.struct(p.alias("period"), F.element_at(as_map, p).alias("raw"), F.map_contains_key(as_map, p).alias("there"))), lambda x: x["there"])
    pairs = F.when(as_list.isNotNull(), F.transform(as_list, lambda v, i: F.struct(F.coalesce(F.get("axis", i), F.when(F.size("axis") > 0, F.concat(F.lit("col_"), i.cast("string"))).otherwise(i.cast("string"))).alias("period"), v.alias("raw"))))
    pairs = pairs.when(as_map.isNotNull() & (F.size("axis") > 0), F.transform(by_axis, lambda x: F.struct(x["period"].alias("period"), x["raw"].alias("raw"))))
    pairs = pairs.when(as_map.isNotNull(), F.transform(F.map_entries(as_map), lambda e: F.struct(normalize_text(e["key"]).alias("period"), e["value"].alias("raw"))))
    pairs = pairs.when(one.isNotNull(), F.array(F.struct(F.lit("value").alias("period"), one.alias("raw"))))
    drawn = series.where(F.schema_of_variant("row").startswith("OBJECT")).withColumn("pairs", pairs).where(F.size("pairs") > 0)
    s_rows = drawn.select(*keys, F.lit(0).alias("of"), "pos", F.coalesce(F.nullif(of("name", "label", "metric"), F.lit("")), F.concat(F.lit("series_"), F.col("pos").cast("string"))).alias("item"), F.concat(F.lit("chart_"), F.col("chart_type")).alias("row_type"), "page_idx", "pairs")
    # A zero, like an empty value, gives way to the next key.
    filled = lambda k: F.nullif(F.nullif(_get(k, "string", "row"), F.lit("")), F.lit("0"))
    value = F.coalesce(filled("value"), filled("amount"), filled("percent"))
    period = F.coalesce(F.nullif(of("period", "metric_period"), F.lit("")), F.lit("annotation_value"))
    noted = notes.where(F.schema_of_variant("row").startswith("OBJECT")).where(parse_number(value).isNotNull())
    n_rows = noted.select(*keys, F.lit(1).alias("of"), "pos", F.coalesce(F.nullif(of("label", "metric", "text"), F.lit("")), F.concat(F.lit("annotation_"), F.col("pos").cast("string"))).alias("item"), F.lit("chart_annotation").alias("row_type"), "page_idx", F.array(F.struct(period.alias("period"), value.alias("raw"))).alias("pairs"))
    every = s_rows.unionByName(n_rows)
    order = Window.partitionBy(*keys).orderBy("of", "pos")
    every = every.withColumn("row_seq", (F.row_number().over(order) - 1).cast("int")).drop("of", "pos")
    cells = every.select(*keys, "row_seq", F.posexplode("pairs").alias("cell_index", "p")).select(*keys, "row_seq", "cell_index", F.col("p.period").alias("period"), F.col("p.raw").alias("raw"), parse_number("p.raw").alias("value"))
    labels = every.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_seq", F.transform("pairs", lambda p: p["period"]).alias("ps")))), lambda x: x["ps"]))).alias("seen"))
    tables = named.join(labels, keys).select(
        *keys, slugify_name(F.coalesce(F.nullif(F.col("title_text"), F.lit("")), F.col("chart_type"))).alias("name"), F.coalesce(F.nullif(F.col("title_text"), F.lit("")), F.col("chart_type")).alias("title"), "unit",
        F.lit("chart_metrics").alias("table_type"), first_text(text("note"), text("footnote")).alias("footnote"), F.array_distinct(F.concat("axis", "seen")).alias("periods"),
        F.col("page_idx").alias("page_start"), F.col("page_idx").alias("page_end"), "bbox", F.lit("unknown").alias("role") if "role" not in blocks.columns else F.coalesce(F.nullif(normalize_text("role"), F.lit("")), F.lit("unknown")).alias("role"),
    )
    rows = every.join(named.select(*keys, "bbox"), keys).select(*keys, "row_seq", "item", "row_type", F.array().cast("array<string>").alias("components"), F.col("page_idx").alias("page"), "bbox")
    return Tables(tables, rows, cells)


def narrative_metrics(texts: DataFrame) -> DataFrame:
    """``texts`` (any columns and ``block_text``) with item, amount and change: a row for each metric that a text states."""
    rows = []
    for label, first, second in NARRATIVES:
        pattern = rf"(?i)(?:over|approximately|about)?\s*\$?\s*(\d+(?:\.\d+)?)\s*billi?on\s*(?:in)?\s*{first}\s*{second}[^\d]{{0,40}}(?:up|increased?|growth)\s*(\d+(?:\.\d+)?)\s*percent"
        rows.append(F.when(F.col("block_text").rlike(pattern), F.struct(F.lit(label).alias("item"), F.regexp_extract("block_text", pattern, 1).alias("amount"), F.regexp_extract("block_text", pattern, 2).alias("change"))))
    return texts.withColumn("m", F.explode(F.array_compact(F.array(*rows)))).select(*texts.columns, "m.*")


def stack_tables(*parts: Tables) -> Tables:
    """Tables of several sources, numbered on within each task: all of the first source, then of the second, ..."""
    every = {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(p, k).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]) for k in ("tables", "rows", "cells")}
    order = Window.partitionBy("task_id").orderBy("part", "table_seq")
    numbered = every["tables"].withColumn("new_seq", F.row_number().over(order).cast("long") - 1)
    to = numbered.select("task_id", "part", "table_seq", "new_seq")

    def moved(d: DataFrame) -> DataFrame:
        return d.join(to, ["task_id", "part", "table_seq"]).withColumn("table_seq", F.col("new_seq")).drop("part", "new_seq")

    return Tables(numbered.withColumn("table_seq", F.col("new_seq")).drop("part", "new_seq"), moved(every["rows"]), moved(every["cells"]))


def narrative_tables(blocks: DataFrame, with_tables: DataFrame) -> Tables:
    """One table of narrative metrics for each task that isn't in ``with_tables`` (task_id) and states any."""
    keys = ["task_id", "table_seq"]
    src = blocks.where("not is_table").join(with_tables, "task_id", "left_anti").withColumn("table_seq", F.lit(0).cast("long"))
    told = narrative_metrics(src.select(*keys, "block_seq", "page_idx", "bbox", "block_text"))
    order = Window.partitionBy(*keys).orderBy("block_seq", "item")
    rows = told.withColumn("row_seq", (F.row_number().over(order) - 1).cast("int"))
    pairs = F.array(F.struct(F.lit("amount_usd_billions").alias("period"), F.col("amount").alias("raw")), F.struct(F.lit("year_over_year_percent").alias("period"), F.col("change").alias("raw")))
    cells = rows.select(*keys, "row_seq", F.posexplode(pairs).alias("cell_index", "p")).select(*keys, "row_seq", "cell_index", F.col("p.period").alias("period"), F.col("p.raw").alias("raw"), parse_number("p.raw").alias("value"))
    tables = rows.groupBy(*keys).agg(F.min("page_idx").alias("page_start"), F.max("page_idx").alias("page_end")).select(
        *keys, F.lit("financial_metrics_from_ocr_text").alias("name"), F.lit("Financial Metrics From OCR Text").alias("title"), F.lit("USD billion; percent").alias("unit"), F.lit("narrative_metrics").alias("table_type"),
        F.lit("").alias("footnote"), F.array(F.lit("amount_usd_billions"), F.lit("year_over_year_percent")).alias("periods"), "page_start", "page_end", F.lit(None).cast("string").alias("bbox"), F.lit("unknown").alias("role"),
    )
    kept = rows.select(*keys, "row_seq", "item", F.lit("narrative_metric").alias("row_type"), F.array().cast("array<string>").alias("components"), F.col("page_idx").alias("page"), "bbox")
    return Tables(tables, kept, cells)


def _cut_lineage(t: Tables) -> Tables:
    """Each of the three is read several times by what follows."""
    return Tables(*[checkpointed(d) for d in (t.tables, t.rows, t.cells)])


def materialize_tables(blocks: DataFrame, parity: bool = False) -> Tables:
    """The whole of structuring: context, tables, merge, charts, narrative fallback, references."""
    from .references import reference_tables

    blocks = blocks.drop("input_index") if parity else blocks
    ready = checkpointed(carry_context(block_texts(classify(blocks)), ["task_id", *_input(blocks)]))
    both = _cut_lineage(stack_tables(merge_cross_page(normalize_tables(ready)), chart_tables(ready)))
    told = narrative_tables(ready, both.tables.select("task_id").distinct())
    every = _cut_lineage(stack_tables(both, told))
    return stack_tables(every, reference_tables(ready, every))
