"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A task of :func:`dealt` gets about this many rows, so its sorts and hash tables stay small however large the input is.
ROWS_A_TASK = 250_000


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: a lineage cut of which a reader takes only the columns that it needs."""
    path = f"{_folder(df.sparkSession)}/tablewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over a number of tasks that grows with ``rows``; what is dealt alike is joined by ``keys`` and more where it lies."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > 1 else df.repartition(*keys)
