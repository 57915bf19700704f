"""Helpers shared by the corpus operators: shared storage, size-checked joins, batch bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker, where the session keeps Spark's defaults. All
#: operators set the same, so none depends on which ran before.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"
#: A side of a join is broadcast only after its rows and bytes were counted and found to be at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Paths of the tables that this session stored, in order; those of a result that is read lazily must stay.
WRITTEN: list[str] = []
#: A-Z and a-z, for translate(): lower-casing that leaves every other character alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests in one process) one is made and set; on a cluster it must be set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tablewright-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage, so that a costly step runs once and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        WRITTEN.remove(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes of an Arrow batch, unless the session has set its own numbers."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", str(ARROW_ROWS)), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def _bytes(name: str, kind: str) -> Column:
    """About how many bytes a value takes."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0))
    if kind in ("array<string>", "array<binary>"):
        return F.coalesce(F.aggregate(name, F.lit(0), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
    return F.lit(8)


def fits(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Does a table have at most ``rows`` rows and about ``size`` bytes? Reads at most ``rows`` + 1 of its rows."""
    width = sum((_bytes(f"`{n}`", k) for n, k in small.dtypes), F.lit(8))
    n, held = small.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (held or 0) <= size


def sized(small: DataFrame) -> DataFrame:
    """``small``, which should be a stored table, with a broadcast hint if it fits; as it is (shuffle join) beyond."""
    return F.broadcast(small) if fits(small) else small


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in, which then does the same."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_print(column: str = "text"):
    """With doc_id, what tells rows apart: a hash of the text and its length."""
    return F.xxhash64(column, F.length(column))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    known = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in known:
        pass
    return name


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, print) isn't in ``keys``, a stored table; null ids match null ids."""
    key, of = fresh_name(docs, "id"), fresh_name(docs, "print")
    k = sized(keys.select(F.col("doc_id").alias(key), F.col("print").alias(of)))
    return docs.join(k, docs["doc_id"].eqNullSafe(F.col(key)) & (text_print() == F.col(of)), "left_anti")
