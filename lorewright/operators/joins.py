"""Joins that hold up where one key has a large part of all rows, and connected components built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written

#: A key is hot if it has more than one part in so many of all rows; so there are at most as many hot keys.
PARTS = 4096
#: Size of the bitmap that keys are looked up in before a join: 4 MB.
BITS = 1 << 25


def hot_bound(total: int, parts: int = PARTS) -> int:
    return max(64, total // parts)


def join_counted(rows: DataFrame, side: DataFrame, on: list[str], total: int, count: str = "n", parts: int = PARTS) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row for each key and in ``count`` the number of ``rows`` with it.

    The side's rows of hot keys, ``parts`` at most at any size, are broadcast, so the rows of a hot key stay where they
    are; all others are shuffled. ``total``: the number of ``rows``.
    """
    bound = hot_bound(total, parts)
    hot = side.where(F.col(count) > bound).drop(count)
    plain = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(side.where(F.col(count) <= bound).drop(count), on)
    return plain.unionByName(rows.join(F.broadcast(hot), on))


def among(rows: DataFrame, key: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``keys`` (key) and a few others, before a join with these: by a bitmap of hashes, a
    single row of bounded size that is broadcast, so that the others are not shuffled for the join."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    word = keys.groupBy(F.floor(at / 64).cast("bigint").alias("id")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64({key}), {bits}) % 64 AS int)))").alias("w"))
    every = keys.sparkSession.range(bits // 64).join(word, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))).alias("w"))
    bitmap = written(every.select(F.col("w.w").alias("__bitmap")))
    return rows.join(F.broadcast(bitmap), F.getbit(F.get("__bitmap", F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1, "left_semi")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _joined(rows: DataFrame, side: DataFrame, on: str, total: int, hot: bool) -> DataFrame:
    return join_counted(rows, written(side), [on], total) if hot else rows.join(side.drop("n"), on)


def _large_star(edges: DataFrame, total: int, hot: bool) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return _joined(both.where("v > u"), least, "u", total, hot).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int, hot: bool) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the smallest of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _joined(edges, least, "a", total, hot).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: two orderable columns); root is the smallest node it reaches.

    By alternating large-star and small-star steps. Self-links and repeated links may occur; nodes that only link to
    themselves are not returned. Every round is written to the shared folder, so a lost executor costs one round at most.
    Where a node has a large part of all links, the round joins by :func:`join_counted`.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, total = tuple(seen), seen[0]
        hub = _both(now).groupBy("u").count().agg(F.max("count")).first()[0]
        hot = hub > hot_bound(total)
        large = _large_star(now, total, hot)
        now = written(_small_star(written(large) if hot else large, total, hot))
