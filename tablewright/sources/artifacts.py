"""Block sources: parser artifacts as JSON text, HTML files, and stores of tasks and trace events.

Blocks are rows of (task_id, input_index, role, block_seq, page_idx, block_type, bbox, content, title,
text): ``content`` is a VARIANT, ``bbox`` JSON text. Sequence numbers come from positions in the source,
never from partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File suffixes of an artifact set, and a second name for two of them.
ARTIFACTS = {"markdown": ".md", "content_list": "_content_list.json", "content_list_v2": "_content_list_v2.json", "middle": "_middle.json", "model": "_model.json", "layout": "_layout.pdf", "span": "_span.pdf"}
FALLBACKS = {"layout": "layout.pdf", "span": "span.pdf"}

_BLOCK = """
  try_variant_get({v}, '$.page_idx', 'int') AS own_page, coalesce(try_variant_get({v}, '$.type', 'string'), '') AS block_type,
  to_json(try_variant_get({v}, '$.bbox', 'variant')) AS bbox, try_variant_get({v}, '$.content', 'variant') AS content,
  try_variant_get({v}, '$.title', 'string') AS title, try_variant_get({v}, '$.text', 'string') AS text
"""


def discover_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """kind, path of each artifact under a folder: the first path in order; a fallback name only if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return pick_artifacts(files)


def pick_artifacts(files: DataFrame) -> DataFrame:
    """kind, path from a list of paths (op 8 lists the same)."""
    rules = [(k, 0, s) for k, s in ARTIFACTS.items()] + [(k, 1, s) for k, s in FALLBACKS.items()]
    pairs = F.array(*[F.when(F.endswith("path", F.lit(s)), F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rank"))) for k, r, s in rules])
    found = files.select("path", F.explode(F.array_compact(pairs)).alias("x"))
    return found.groupBy(F.col("x.kind").alias("kind")).agg(F.min_by("path", F.struct("x.rank", "path")).alias("path"))


def read_json_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, json (the whole file). A missing folder is the caller's failure, an empty file null."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.nullif(F.trim("value"), F.lit("")).alias("json"))


def _kind(v: str) -> str:
    """array, object or scalar, without a look inside."""
    return f"CASE WHEN try_variant_get({v}, '$', 'array<variant>') IS NOT NULL THEN 'array' WHEN try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL THEN 'object' ELSE 'scalar' END"


def _numbered(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("task_id").orderBy("page_pos", "block_pos")
    return blocks.select(
        "task_id", (F.row_number().over(order) - 1).cast("long").alias("block_seq"), F.coalesce("own_page", "page").cast("int").alias("page_idx"),
        F.lower(F.trim("block_type")).alias("block_type"), "bbox", "content", "title", "text",
    )


def flatten_v2(artifacts: DataFrame) -> DataFrame:
    """Blocks of (task_id, json) page lists: a page is a list of blocks or one block, the file may be one block.

    The page's place is the page number of blocks without their own. A file that is one block has no page.
    """
    # One element for each page, wherever it comes from, and one block for each element: a file is parsed once.
    listed = lambda v, other: f"CASE {_kind(v)} WHEN 'array' THEN try_variant_get({v}, '$', 'array<variant>') WHEN 'object' THEN {other} END"
    rows = artifacts.sparkSession.sql(
        f"""
        WITH file AS (SELECT task_id, try_parse_json(json) AS v FROM {{a}}),
        page AS (SELECT task_id, {_kind("v")} = 'object' AS single, posexplode({listed("v", "array(v)")}) AS (page_pos, v) FROM file),
        block AS (SELECT task_id, page_pos, CASE WHEN single THEN NULL ELSE page_pos END AS page, posexplode({listed("v", "array(v)")}) AS (block_pos, v) FROM page)
        SELECT task_id, page_pos, block_pos, page, {_BLOCK.format(v="v")} FROM block WHERE {_kind("v")} = 'object'
        """,
        a=artifacts,
    )
    return _numbered(rows)


def flatten_legacy(artifacts: DataFrame) -> DataFrame:
    """Blocks of a flat list, of the first list under content_list, blocks or items, or of the one object."""
    rows = artifacts.sparkSession.sql(
        f"""
        WITH file AS (SELECT task_id, try_parse_json(json) AS v FROM {{a}}),
        inner_list AS (SELECT task_id, v, coalesce(CASE WHEN {_kind("v")} = 'array' THEN v END,
          {", ".join(f"CASE WHEN {_kind(f"try_variant_get(v, '$.{k}', 'variant')")} = 'array' THEN try_variant_get(v, '$.{k}', 'variant') END" for k in ("content_list", "blocks", "items"))}) AS list FROM file),
        block AS (
          SELECT l.task_id, b.pos AS block_pos, b.value AS v FROM inner_list l, LATERAL variant_explode(l.list) b
          UNION ALL SELECT task_id, 0, v FROM inner_list WHERE list IS NULL)
        SELECT task_id, 0 AS page_pos, block_pos, NULL AS page, {_BLOCK.format(v="v")} FROM block WHERE {_kind("v")} = 'object'
        """,
        a=artifacts,
    )
    return _numbered(rows)


def flatten_middle(artifacts: DataFrame, parity: bool = False) -> DataFrame:
    """Blocks of page records (pdf_info, pages or the list itself), from preproc_blocks, para_blocks or blocks.

    Each page gives its first list that isn't empty. With ``parity`` a page behind one that gave blocks
    stops at its first list even if that is empty.
    """
    keys = ("preproc_blocks", "para_blocks", "blocks")
    get = lambda k: f"try_variant_get(v, '$.{k}', 'variant')"
    full = lambda k: f"CASE WHEN {_kind(get(k))} = 'array' AND try_variant_get(v, '$.{k}[0]', 'variant') IS NOT NULL THEN {get(k)} END"
    any_ = lambda k: f"CASE WHEN {_kind(get(k))} = 'array' THEN {get(k)} END"
    rows = artifacts.sparkSession.sql(
        f"""
        WITH file AS (SELECT task_id, try_parse_json(json) AS v FROM {{a}}),
        list AS (SELECT task_id, coalesce(CASE WHEN {_kind("v")} = 'array' THEN v END, {any_("pdf_info")}, {any_("pages")}) AS v FROM file),
        page AS (SELECT l.task_id, p.pos AS page_pos, p.value AS v FROM list l, LATERAL variant_explode(l.v) p),
        chosen AS (SELECT task_id, page_pos, v, coalesce({", ".join(map(full, keys))}) AS full_list, coalesce({", ".join(map(any_, keys))}) AS first_list FROM page),
        seen AS (SELECT *, coalesce(max(CASE WHEN full_list IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY page_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chosen)
        SELECT s.task_id, s.page_pos, b.pos AS block_pos, coalesce(try_variant_get(s.v, '$.page_idx', 'int'), s.page_pos) AS page, {_BLOCK.format(v="b.value")}
        FROM seen s, LATERAL variant_explode({"CASE WHEN s.before = 1 THEN s.first_list ELSE s.full_list END" if parity else "s.full_list"}) b
        """,
        a=artifacts,
    )
    return _numbered(rows)


def prefer_blocks(*sources: DataFrame) -> DataFrame:
    """Of each task the blocks of its first source that has any."""
    from functools import reduce

    ranked = reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = F.min("source_rank").over(Window.partitionBy("task_id"))
    return ranked.withColumn("best", best).where("source_rank = best").drop("best", "source_rank")


def latest_tasks(versions: DataFrame, order: str = "updated_at") -> DataFrame:
    """The task store read back: of the versions of each task_id, the latest (ties: the larger row in order)."""
    rest = [c for c in versions.columns if c not in ("task_id", order)]
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc(order), *[F.desc(c) for c in rest]))
    return versions.withColumn("rank", rank).where("rank = 1").drop("rank")


def append_trace(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def filter_trace(events: DataFrame, stages: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Trace events of given stages, and of given event types if any are named."""
    kept = events.where(F.col("stage").isin(*stages))
    return kept.where(F.col("event_type").isin(*kinds)) if kinds else kept


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256 (lowercase hex) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line for each task."""
    results.write.mode("overwrite").json(path)
