"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.llm import near_texts, packing, quality, secret_scan, settings
from sensorcast.llm.queries import mixed, ratings
from sensorcast.llm.shipping import ship
from sensorcast.staging import stage

# Common shingles of near copies; the thin query op3_ has a figure of its own.
NEAR_PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on their ratings, takes for good."""
    ship(spark)
    return quality.select(docs, quality.train(docs, ratings(spark, sf_dir)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the group's first text under its smallest doc_id.

    Rows without words stay. Texts that only rows without doc_id have are compared for equality alone."""
    ship(spark)
    found = stage(near_texts.classified(docs, NEAR_PERCENT).filter("d1 is not null"), "classes-of-rows")
    chosen = F.coalesce("first", F.lit(True)) & F.col("doc_id").eqNullSafe(F.col("rep"))
    own = F.col("doc_id").alias("__id"), F.col("d1").alias("__e1"), F.col("d2").alias("__e2")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d1") == F.col("__e1")) & (F.col("__d2") == F.col("__e2"))
    left = near_texts.with_class(docs).join(found.filter(~chosen).select(*own).distinct(), same, "left_anti")
    repeated = stage(found.filter(chosen).groupBy(*own).count().filter("count > 1"), "repeated-rows")
    if not repeated.isEmpty():
        single = left.join(repeated, same, "left_anti")
        left = single.unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["__d1", "__d2"]))
    return left.drop("__d1", "__d2")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their shares."""
    made = mixed(docs)
    return made.filter(F.col(made.columns[-1])["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training, a row per piece of a document."""
    ship(spark)
    return packing.pack(
        docs,
        settings.BYTE_BPE,
        settings.BYTE_BPE_RANKS,
        settings.BYTE_BPE_PATTERN,
        settings.TOKENS_PER_SEQUENCE,
    )


STAGES = [
    ("quality classifier", good),
    ("near-duplicates", distinct),
    ("secrets", without_secrets),
    ("mixture", mixture),
    ("packing", packed),
]

# Trained weights, signatures and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
