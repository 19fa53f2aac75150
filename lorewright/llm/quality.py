"""Operator 6, quality classifier: hashed word n-gram logistic regression trained by FTRL updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, is_held_out, map_text, read_table
from .linear import BITS, fit, margins

#: Labelled documents of each class that training takes at most (the first by a hash of their id).
PER_CLASS = 2000
_MADE = T.StructType([T.StructField("score", T.DoubleType())])


def train_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, epochs: int = 4) -> np.ndarray | None:
    """Weights for label 1, from the rows that are not held out; None if no labelled row is left.

    Labels other than 0 and 1, and null ids, are passed over. A document with several labels counts once for each.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("string").alias("label")).where(~is_held_out("__id")).distinct()
    rank = F.xxhash64(F.col("__id").cast("string"))
    # ids first: the texts of rows that training cannot take are not shuffled
    counts = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, 2 * (per_class + 6 * per_class**0.5 + 10) / n)
        keep = keep | ((F.col("label") == value) & (rank <= int(-(2**63) + min(share * 2**64, 2**64 - 1))))
    marks = F.broadcast(marks.where(keep))  # distinct ids, about 4 * per_class of them at any corpus size
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text")).join(marks, "__id").select("label", "text", rank.alias("rank"))
    classes, weights = fit(rows, per_class=per_class, bits=BITS, epochs=epochs)
    if weights is None:
        return None
    if classes == ["0"]:
        return -weights[0]
    return weights[classes.index("1")]


def score_quality(docs: DataFrame, weights: np.ndarray | None, *, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from a score of 0.5).

    Every row is scored over its whole text. An empty or null text gets the score of the bias alone; without weights
    every score is 0.5. Other columns are carried; ``score`` and ``predicted`` of the input are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats, whatever the corpus

    def make():
        w = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            margin = np.zeros(len(texts)) if w is None else margins(texts, w[None, :])[:, 0]
            return [pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))]

        return work

    scored = map_text(docs, text, make, _MADE, carry_text)
    keep = [c for c in carried(docs, ["score", "predicted"]) if carry_text or c != text]
    return scored.select(*[f"`{c}`" for c in keep], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, weights, carry_text=False)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
