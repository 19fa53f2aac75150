"""Engine tables derived from the driver's tables: notes, chunks, mentions, relations, claims, activity (mapping in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import VectorCells
from ..operators.index import WeightIndex, WordIndex
from ..store import scratch, written

#: The instant that stands for "now" wherever a query needs one.
NOW_MS = 1735689600000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer partitions than the cluster has cores is dealt out to all; others, as large ones, stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC: the note table over ``documents``; every column is a function of the row alone."""
    n = F.col("doc_id")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    last = table(spark, sf_dir, "documents").select(F.max("doc_id").alias("last_id"))
    created = F.lit(1704067200000) + n * 3_600_000
    updated = created + (n % 7) * DAY_MS
    return docs.crossJoin(F.broadcast(last)).select(
        F.concat(F.lit("d"), n).alias("id"),
        F.when(n % 10 == 0, "private").when(n % 10 == 1, "team:alpha").otherwise("local").alias("scope"),
        F.element_at(F.array(*[F.lit(x) for x in ("semantic", "episodic", "procedural", "reference")]), (n % 4 + 1).cast("int")).alias("type"),
        F.substring(F.split("text", "\n", 2)[0], 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        (F.lit(0.5) + (n % 6) / 10).alias("confidence"),
        F.when(n % 3 != 0, created).alias("valid_from"),
        F.when(n % 11 == 0, created + 30 * DAY_MS).alias("valid_to"),
        F.when((n % 13 == 0) & (n < F.col("last_id")), F.concat(F.lit("d"), n + 1)).alias("superseded_by"),
        created.alias("created_at"),
        updated.alias("updated_at"),
        F.when(n % 17 == 0, updated).alias("deleted_at"),
        F.when(n % 5 > 0, updated).alias("last_access_at"),
        (n % 5).alias("access_count"),
        F.lit(0.5).alias("utility"),
    )


_INDEXES: dict[tuple, object] = {}


def kept_index(spark: SparkSession, sf_dir: str, kind: str, build, tables: tuple[str, ...] = ("documents",)):
    """The index ``build(path)`` over tables of a folder, built once for each state of their files and kept in the shared folder."""
    files = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(path)
        files += fs.listStatus(path) if status.isDirectory() else [status]
    state = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, kind, state)
    if key not in _INDEXES:
        _INDEXES[key] = build(scratch(spark, f"index-{kind}"))
    return _INDEXES[key]


def word_index(spark: SparkSession, sf_dir: str) -> WordIndex:
    return kept_index(spark, sf_dir, "words", lambda path: WordIndex.keep(notes(spark, sf_dir), path))


def weight_index(spark: SparkSession, sf_dir: str) -> WeightIndex:
    return kept_index(spark, sf_dir, "weights", lambda path: WeightIndex.keep(active(notes(spark, sf_dir)), path))


def vector_cells(spark: SparkSession, sf_dir: str) -> VectorCells:
    return kept_index(spark, sf_dir, "cells", lambda path: VectorCells.keep(chunks(spark, sf_dir), path), ("documents", "embeddings"))


def active(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at IS NULL")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One embedded chunk per note that has a vector; two models."""
    have = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("memory_id"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("memory_id"), F.lit(0).alias("seq"), F.col("embedding"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"))
    return rows.join(have, "memory_id", "left_semi")


def mentions(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """(memory_id, entity): a note mentions the names of the parts in its order. ``words`` (word): only names with one of them."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.trim("p_name")).alias("entity"))
    if words is not None:
        named = parts.select("entity").distinct().select("entity", F.explode(F.split("entity", " ")).alias("word"))
        # written, so that it is known when these are few or none
        parts = written(parts.join(named.join(words, "word", "left_semi").select("entity"), "entity", "left_semi"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return items.join(parts, "l_partkey").select(F.concat(F.lit("d"), "l_orderkey").alias("memory_id"), "entity").distinct()


def concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, concept) with part keys as concepts: the larger graph."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), "l_orderkey").alias("memory_id"), F.col("l_partkey").alias("concept")).distinct()


def co_ordered(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """(source, target, memory_id, at): pairs of parts in one order; an order has a few parts, so pairs stay few."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = items.alias("a"), items.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey")))
    return pairs.select(F.col("a.l_partkey").alias("source"), F.col("b.l_partkey").alias("target"), F.concat(F.lit("d"), "a.l_orderkey").alias("memory_id"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges: customers are located in nations, nations are part of regions."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("c_name").alias("source"), F.lower("n_name").alias("target"), F.lit("located in").alias("relation"))
    part_of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("source"), F.lower("r_name").alias("target"), F.lit("part of").alias("relation"))
    return located.unionAll(part_of)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of clients over ``events``: id, at (ms), client, tool, text."""
    tool = F.when(F.col("event_type") == "view", "memory_search").when(F.col("event_type") == "signup", "memory_save").when(F.col("event_type") == "purchase", "memory_list").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), F.concat(F.lit("client-"), F.col("user_id") % 12).alias("client"), tool.alias("tool"), F.col("props").alias("text"), F.concat(F.lit("d"), F.col("event_id") % 1200).alias("memory_id"))


NOTES_SQL = """
notes AS (
  SELECT 'd' || doc_id AS id,
         CASE doc_id % 10 WHEN 0 THEN 'private' WHEN 1 THEN 'team:alpha' ELSE 'local' END AS scope,
         CASE doc_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' ELSE 'reference' END AS type,
         substr(split_part(text, chr(10), 1), 1, 60) AS title, text AS content, [lang, source] AS tags,
         0.5::DOUBLE + (doc_id % 6) / 10::DOUBLE AS confidence,
         CASE WHEN doc_id % 3 <> 0 THEN 1704067200000 + doc_id * 3600000 END AS valid_from,
         CASE WHEN doc_id % 11 = 0 THEN 1704067200000 + doc_id * 3600000 + 30 * 86400000::BIGINT END AS valid_to,
         CASE WHEN doc_id % 13 = 0 AND doc_id < (SELECT max(doc_id) FROM documents) THEN 'd' || (doc_id + 1) END AS superseded_by,
         1704067200000 + doc_id * 3600000 AS created_at,
         1704067200000 + doc_id * 3600000 + (doc_id % 7) * 86400000 AS updated_at,
         CASE WHEN doc_id % 17 = 0 THEN 1704067200000 + doc_id * 3600000 + (doc_id % 7) * 86400000 END AS deleted_at,
         CASE WHEN doc_id % 5 > 0 THEN 1704067200000 + doc_id * 3600000 + (doc_id % 7) * 86400000 END AS last_access_at,
         doc_id % 5 AS access_count, 0.5::DOUBLE AS utility, doc_id
  FROM documents)"""

CHUNKS_SQL = """
chunks AS (
  SELECT 'd' || vec_id AS memory_id, 0 AS seq, embedding::DOUBLE[] AS embedding, 'm' || (label % 2) AS model, vec_id
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"""

MENTIONS_SQL = """
mentions AS (
  SELECT DISTINCT 'd' || l_orderkey AS memory_id, lower(trim(p_name)) AS entity
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CONCEPTS_SQL = "cm AS (SELECT DISTINCT 'd' || l_orderkey AS memory_id, l_partkey AS concept FROM lineitem)"

PAIRS_SQL = """
items AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (
  SELECT a.l_partkey AS source, b.l_partkey AS target, 'd' || a.l_orderkey AS memory_id
  FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""

CLAIMS_SQL = """
claims AS (
  SELECT lower(c_name) AS source, lower(n_name) AS target, 'located in' AS relation FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT lower(n_name), lower(r_name), 'part of' FROM nation JOIN region ON n_regionkey = r_regionkey)"""

ACTIVITY_SQL = """
activity AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS "at", 'client-' || (user_id % 12) AS client,
         CASE event_type WHEN 'view' THEN 'memory_search' WHEN 'signup' THEN 'memory_save' WHEN 'purchase' THEN 'memory_list' ELSE event_type END AS tool,
         props AS text, 'd' || (event_id % 1200) AS memory_id
  FROM events)"""
