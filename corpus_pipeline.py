"""A corpus pipeline of five operators: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm.common import read_table, scratch
from lorewright.llm.decontaminate import decontaminate
from lorewright.llm.mixing import mix_to_targets
from lorewright.llm.neardup import drop_near_duplicates
from lorewright.llm.quality import score_quality, train_quality
from lorewright.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more; the labels teach the classifier on the documents that are here."""
    weights = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, weights).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return drop_near_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; the default targets take from no language, so none is lost.

    Rows come once for each copy. A rate below one that rounds to no copy is lifted to one copy, so totals can exceed
    the fitted ones.
    """
    mixed = mix_to_targets(docs, docs.select("doc_id", F.col("lang").alias("domain")))
    repeated = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    return repeated.select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot."""
    return shard(docs)


STAGES = [("quality classifier", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL cannot say the fitted stages; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
