"""Textual references ("the growth", "该金额") resolved to metrics by a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kind_of, normalize_text, reference_mentions, year_from_text

# Fixed values.
KIND_POINTS, AMOUNT_POINTS, PERIOD_POINTS, WORD_POINTS = 6.0, 3.0, 2.0, 0.5
NEAR_POINTS, PER_PAGE, MOST_PAGES, AHEAD_POINTS = 2.0, 0.35, 4, -1.0
LEAST_SCORE, BASE_CONFIDENCE, MOST_CONFIDENCE, SCORE_UNIT = 3.0, 0.55, 0.96, 12
AMOUNT_KINDS = ["revenue", "profit", "cash_flow", "amount"]
# End of fixed values.


def metric_candidates(t) -> DataFrame:
    """All cells with a value: task_id, cand_seq, table, label, period, value, unit, page, kind. Equal periods of a row: the last."""
    from .structure import lines_of, unfolded

    if t.nested is not None:
        # Texts of tables and rows are normalised before they are unfolded to cells.
        lines = lines_of(t.nested.withColumns({"unit": normalize_text("unit"), "title": normalize_text("title")})).withColumn("item", normalize_text("item"))
        once = unfolded(lines).where("is_last and value is not null")
    else:
        key = ["task_id", "table_seq", "row_seq"]
        last = Window.partitionBy(*key, "period").orderBy(F.desc("cell_index"))
        cells = t.cells.withColumn("rank", F.row_number().over(last)).where("rank = 1 and value is not null").drop("rank")
        r, h = t.rows.select(*key, normalize_text("item").alias("item"), "page"), t.tables.select("task_id", "table_seq", "name", normalize_text("title").alias("title"), normalize_text("unit").alias("unit"), "page_start")
        once = cells.join(r, key).join(h, ["task_id", "table_seq"])
    told = once.withColumn("period", normalize_text("period")).withColumn("words", F.lower(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("item", "period", "title")])))
    return told.select("task_id", F.struct("table_seq", "row_seq", "cell_index").alias("cand_seq"), F.col("name").alias("table"), F.col("item").alias("label"), "period", "value", "unit", F.coalesce("page", "page_start").alias("page"), kind_of(F.col("words")).alias("metric_kind"))


def score(kind: Column, period: Column, page: Column, phrase: Column) -> Column:
    """Points of a candidate's metric_kind, period, page and label for a mention."""
    match = F.when(F.col("metric_kind") == kind, KIND_POINTS).when((kind == "amount") & F.col("metric_kind").isin(*AMOUNT_KINDS), AMOUNT_POINTS).otherwise(0.0)
    year = F.when((period != "") & (F.col("period") == period), PERIOD_POINTS).otherwise(0.0)
    distance = page - F.col("page")
    near = F.when(distance >= 0, F.greatest(F.lit(0.0), F.lit(NEAR_POINTS) - F.least(distance, F.lit(MOST_PAGES)) * F.lit(PER_PAGE))).when(distance < 0, AHEAD_POINTS).otherwise(0.0)
    word = F.exists(F.split(F.lower(phrase), " "), lambda w: (F.char_length(w) > 2) & F.contains(F.lower(F.col("label")), w))
    return match + year + near + F.when(word, WORD_POINTS).otherwise(0.0)


def resolve(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each mention (task_id, mention_id, kind, phrase, year, mention_page), if it has enough points.

    Only candidates whose kind or period agrees could reach the least score (without either, nearness and
    a word give at most 2.5), so mentions meet candidates by (task, kind) and by (task, period) alone.
    Ties go to the later page (0 as none), then to the first candidate.
    """
    m = mentions.select("task_id", "mention_id", F.col("kind").alias("m_kind"), F.col("phrase").alias("m_phrase"), F.col("year").alias("m_year"), F.col("mention_page").alias("m_page"))
    kinds = F.when(F.col("m_kind") == "amount", F.array(*[F.lit(k) for k in AMOUNT_KINDS])).otherwise(F.array("m_kind"))
    by_kind = m.withColumn("metric_kind", F.explode(kinds)).join(candidates, ["task_id", "metric_kind"])
    of_kind = F.array_contains(kinds, F.col("metric_kind"))
    by_year = m.where("m_year <> ''").withColumn("period", F.col("m_year")).join(candidates, ["task_id", "period"]).where(~of_kind)
    scored = by_kind.unionByName(by_year).withColumn("score", score(F.col("m_kind"), F.col("m_year"), F.col("m_page"), F.col("m_phrase")))
    page = F.when(F.coalesce("page", F.lit(0)) == 0, -1).otherwise(F.col("page"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("task_id", "mention_id").orderBy(F.desc("score"), F.desc(page), "cand_seq"))).where((F.col("rank") == 1) & (F.col("score") >= LEAST_SCORE))
    return best.withColumn("confidence", F.round(F.least(F.lit(MOST_CONFIDENCE), BASE_CONFIDENCE + F.col("score") / SCORE_UNIT), 2)).drop("rank")


def reference_tables(blocks: DataFrame, t):
    """A table of resolved references for each task that has any, as :class:`.structure.Tables`."""
    from .structure import Tables

    said = blocks.where("not is_table and not is_chart").select("*", F.posexplode(reference_mentions("block_text")).alias("m_pos", "m"))
    order = Window.partitionBy("task_id").orderBy("block_seq", "m_pos")
    mentions = said.select("task_id", F.row_number().over(order).alias("mention_id"), F.col("m.kind").alias("kind"), F.col("m.phrase").alias("phrase"), year_from_text("block_text").alias("year"), F.col("page_idx").alias("mention_page"), "bbox")
    found = resolve(mentions, metric_candidates(t)).join(mentions.select("task_id", "mention_id", "bbox"), ["task_id", "mention_id"])
    keyed = found.withColumn("table_seq", F.lit(0).cast("long")).withColumn("row_seq", (F.row_number().over(Window.partitionBy("task_id").orderBy("mention_id")) - 1).cast("int"))
    rows = keyed.select("task_id", "table_seq", "row_seq", F.col("m_phrase").alias("item"), F.lit("global_reference").alias("row_type"), F.array("label").alias("components"), F.col("m_page").alias("page"), "bbox")
    pairs = F.array(F.struct(F.lit("resolved_value").alias("period"), F.col("value").cast("string").alias("raw"), F.col("value").alias("value")), F.struct(F.lit("confidence").alias("period"), F.format_string("%.2f", F.col("confidence")).alias("raw"), F.col("confidence").alias("value")))
    cells = keyed.select("task_id", "table_seq", "row_seq", F.posexplode(pairs).alias("cell_index", "p")).select("task_id", "table_seq", "row_seq", "cell_index", "p.*")
    tables = keyed.groupBy("task_id", "table_seq").agg(F.min("m_page").alias("page_start"), F.max("m_page").alias("page_end")).select(
        "task_id", "table_seq", F.lit("global_reference_resolution").alias("name"), F.lit("Global Reference Resolution").alias("title"), F.lit("mixed; confidence score").alias("unit"), F.lit("global_reference_resolution").alias("table_type"),
        F.lit("").alias("footnote"), F.array(F.lit("resolved_value"), F.lit("confidence")).alias("periods"), "page_start", "page_end", F.lit(None).cast("string").alias("bbox"), F.lit("unknown").alias("role"),
    )
    return Tables(tables, rows, cells)
