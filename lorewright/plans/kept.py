"""Registered queries of the kept indexes that take changes or are read by cells, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.deltaindex import new_index
from ..sources.tables import NOTES_SQL, active, notes, vector_cells
from .retrieval import BM25_SQL, ORACLE as RETRIEVAL, TERMS, query_vector

_REVISED = " revised widget license"


def delta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06: two thirds of the notes, then the others and new titles, then drops and cut contents; a batch comes twice."""
    n = F.substring("id", 2, 20).cast("bigint")
    rows = notes(spark, sf_dir).select("id", "title", "content", "tags", "deleted_at")
    titled = rows.withColumn("title", F.when(n % 5 == 1, F.concat("title", F.lit(_REVISED))).otherwise(F.col("title")))
    put, drop = F.lit("put").alias("op"), F.lit("drop").alias("op")
    first = rows.where(n % 3 < 2).select("*", put)
    second = titled.where((n % 3 == 2) | (n % 5 == 1)).select("*", put)
    third = titled.where(n % 11 == 4).withColumn("content", F.col("title")).select("*", put, F.lit(0).alias("seq"))
    third = third.unionByName(rows.where(n % 7 == 3).select("*", drop, F.lit(1).alias("seq")))
    index = new_index(spark)
    for batch, changes in enumerate((first, second)):
        index.apply(batch, changes)
    index.apply(1, first)  # batch 1 is there: nothing changes
    index.apply(2, third)
    index.compact()
    return S.bm25(rows, TERMS, index=index).select("id", F.round("bm25", 9).alias("bm25"), "matched")


def vector_cells_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-04: the vector leg, from the cells that can hold a row of it."""
    rows, _ = vector_cells(spark, sf_dir).leg(query_vector(spark, sf_dir), "m0", active(notes(spark, sf_dir)))
    return rows.select("id", F.round("similarity", 6).alias("similarity"))


_CHANGED = f"""{NOTES_SQL.replace('notes AS (', 'loaded AS (', 1)},
titled AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN title || '{_REVISED}' ELSE title END AS title) FROM loaded WHERE doc_id % 7 <> 3),
notes AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 4 THEN title ELSE content END AS content) FROM titled)"""

QUERIES = {"stm_delta_index": delta_index, "ret_vector_cells": vector_cells_band}
ORACLE = {"stm_delta_index": f"WITH {_CHANGED}, {BM25_SQL} SELECT id, round(bm25, 9) AS bm25, matched FROM bm", "ret_vector_cells": RETRIEVAL["ret_vector_band"]}
