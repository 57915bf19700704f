"""From raw documents to token shards: five stages, each calling one operator of ``tablewright.llm``.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it again as the next stage's input. All stages but
the last return the columns of their input. A stage's decisions meet its documents on doc_id and a
hash of the text, so that rows that share an id are told apart and null ids match. Null and empty texts
go through like any other, very long ones count whole, repeated rows are judged alike (near-dedup keeps
one), other columns are handed on whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import common, decontaminate, mixing, quality_cnn, registry, simhash, token_planes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more, null and empty texts among them by their score."""
    net = quality_cnn.fit(docs, common.table(spark, sf_dir, "labels"))
    poor = quality_cnn.quality_scores(docs, net).where("score < 0.5").select("doc_id", "print").distinct()
    return common.without(docs, common.stored(poor, "poor"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the least doc_id; of rows alike, one."""
    found = common.stored(simhash.near_duplicates(docs, by="shingles"), "near-copies")
    kept = common.without(docs, common.stored(found.where("not stays").select("doc_id", "print").distinct(), "copies"))
    if found.where("stays").groupBy("doc_id", "print").count().where("count > 1").limit(1).count():
        once = common.fresh_name(docs, "print")
        kept = kept.withColumn(once, common.text_print()).dropDuplicates(["doc_id", once]).drop(once)
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, common.stored(found.where("contaminated").select("doc_id", "print").distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate towards the target weights says, which may be never."""
    rated = mixing.mix(docs, mixing.label_domains(common.table(spark, sf_dir, "labels")), mixing.TARGETS)
    key, of, copies, copy = (common.fresh_name(docs, n) for n in ("id", "print", "copies", "copy"))
    other = common.stored(rated.where("copies <> 1").select(F.col("doc_id").alias(key), F.col("print").alias(of), F.col("copies").cast("int").alias(copies)), "copies")
    joined = docs.join(common.sized(other), docs["doc_id"].eqNullSafe(F.col(key)) & (common.text_print() == F.col(of)), "left")
    repeated = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(1)))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in token shards in the shared folder, read back from them."""
    return token_planes.token_planes(docs, registry.BYTE_BPE)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]

#: Trained and iterative stages can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and the one it read, go when its result is written; shards stay."""
    docs, read = common.documents(spark, sf_dir), []
    for name, stage in STAGES:
        before = len(common.WRITTEN)
        docs = common.stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        *own, result = common.WRITTEN[before:]
        common.drop_stored(spark, [*own, *read])
        read = [result]
    return docs
