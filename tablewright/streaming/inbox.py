"""An inbox of artifacts as a stream: each batch of whole files runs through the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structure import materialize_tables
from ..sources.artifacts import flatten_v2


def process_inbox(spark: SparkSession, inbox: str, output: str, checkpoint: str):
    """Read new JSON artifacts (a file is a task) and append their tables, rows and cells under ``output``.

    A file is processed whole in one batch, so no window spans batches. Each batch is written under
    its number, and a batch that runs again replaces its own output. Returns the finished query.
    """

    def handle(batch: DataFrame, number: int) -> None:
        found = materialize_tables(flatten_v2(batch))
        for name in ("tables", "rows", "cells"):
            getattr(found, name).write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    files = spark.readStream.format("text").option("wholetext", "true").load(inbox)
    tasks = files.select(F.xxhash64(F.col("_metadata.file_path")).alias("task_id"), F.col("value").alias("json"))
    query = tasks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
