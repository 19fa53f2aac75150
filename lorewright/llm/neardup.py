"""Operator 4, SimHash near-duplicates: fuzzy keys from Golay-decoded fingerprint segments, joined and verified.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Each segment, as a word of the Golay code, is decoded
to one or six nearby codeword indices, such that segments that differ in at most two bits share an index. Two
fingerprints at four bits or fewer then share one of these keys (pigeonhole over the segment errors):

* some segment has no error: the other two have four at most, so one of them has two at most. Key: the exact
  segment and an index of one of the others (six ordered pairs of segments);
* every segment has an error: each has two at most. Key: an index of the first, an index of the second, and one of
  three 7-bit blocks of the third, of which at least one has no error.

That is about 116 keys of 31 bits or more per distinct fingerprint. Each key's members are compared in one pass over
the rows sorted by key; links leave as stars (member, smallest member of its part), never as all pairs. Groups above
``block`` members are not compared there but divided further (:func:`links`), so no task holds one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import components, join_counted
from .common import CHUNK_BYTES, chunks, map_text, read_table, text_bytes, written
from .golay import near_codewords

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Largest group of distinct fingerprints under one key that one task compares.
BLOCK = 16384
_ONES = np.uint64(0x0101010101010101)
_KEYED = T.StructType([T.StructField("k", T.LongType()), T.StructField("f", T.LongType())])
_LINKS = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them; eight byte counters to a machine word."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    parts = (n + 254) // 255  # a byte counts to 255
    owner = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = first[owner] + 255 * nth
    heads = np.cumsum(parts) - parts
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _ONES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        for byte in range(8):
            out[full] |= np.where(2 * sums[:, byte] > n, np.uint64(1 << (8 * byte + shift)), np.uint64(0))
    return out


def _fingerprints() -> object:
    def work(texts: pa.Array) -> list[pa.Array]:
        data, offs = text_bytes(texts)
        found = []
        for a, b in chunks(offs, CHUNK_BYTES):
            rows = [_hashes(data[offs[i] : offs[i + 1]].tobytes()) for i in range(a, b)]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            found.append(majority(np.fromiter((h for row in rows for h in row), np.uint64, int(counts.sum())), counts))
        return [pa.array((np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64))]

    return work


def fingerprints(docs: DataFrame, *, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``simhash`` (a long): majority bits of the XXH64 of word 4-grams; zero for a text without words."""
    return map_text(docs, text, _fingerprints, T.StructType([T.StructField("simhash", T.LongType())]), carry_text)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, index into fps) of an array of unsigned 64-bit fingerprints."""
    x = fps.view(np.int64)
    segments = [x & 0x3FFFFF, (x >> 22) & 0x1FFFFF, (x >> 43) & 0x1FFFFF]
    near = [near_codewords(s) for s in segments]
    own = np.arange(len(x))
    keys, index = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                codes, n = near[j]
                use = np.arange(6) < n[:, None]
                keys.append((((3 * i + j) << 34 | segments[i] << 12)[:, None] | codes)[use])
                index.append(np.repeat(own, n))
    (c0, n0), (c1, n1) = near[:2]
    use = (np.arange(6) < n0[:, None])[:, :, None] & (np.arange(6) < n1[:, None])[:, None, :]
    pair = ((c0[:, :, None] << 12) | c1[:, None, :])[use] << 9
    owner = np.repeat(own, n0 * n1)
    for part in range(3):
        block = (segments[2] >> (7 * part)) & 0x7F
        keys.append((9 << 34) | pair | (part << 7) | block[owner])
        index.append(owner)
    return np.concatenate(keys), np.concatenate(index)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a in range(0, len(fps), 2000):
            part = fps[a : a + 2000]
            keys, index = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[index])], names=["k", "f"])


def _stars(members: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one group: each member that reaches another, and the smallest one of its part."""
    a, b = [], []
    while len(members) > 1:
        root, rest = members[0], members[1:]
        frontier = [root]
        while frontier and len(rest):
            close = np.bitwise_count(rest ^ frontier.pop()) <= DISTANCE
            if close.any():
                got = rest[close]
                a.append(got)
                b.append(np.full(len(got), root, np.uint64))
                frontier.extend(got)
                rest = rest[~close]
        members = rest
    return a, b


def _link(block: int | None):
    """Over rows (key columns..., f), sorted: links of each key's members; members of larger groups have no b."""

    def links(keys: np.ndarray, f: np.ndarray) -> list[pa.RecordBatch]:
        """Whole groups, sorted by key."""
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(cut, len(keys)))
        a, b = [], []
        two = cut[size == 2]
        close = np.bitwise_count(f[two] ^ f[two + 1]) <= DISTANCE
        lo, hi = np.minimum(f[two], f[two + 1])[close], np.maximum(f[two], f[two + 1])[close]
        a.append(hi)
        b.append(lo)
        for start, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _stars(np.unique(f[start : start + n]))
            a += x
            b += y
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            return []
        pairs = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64)
        return [_out(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), False
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            f = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(k):
                continue
            k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
            last = int(np.searchsorted(k, k[-1], "left"))
            if over:  # the first group here goes on from one that was too large
                first = int(np.searchsorted(k, k[0], "right"))
                yield _out(k[:first], f[:first].view(np.int64), None)
                over = first == len(k)
                k, f, last = k[first:], f[first:], max(0, last - first)
            if last:
                yield from _groups(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if block and len(held_k) > block:
                yield _out(held_k, held_f.view(np.int64), None)
                held_k, held_f, over = held_k[-1:], held_f[-1:], True  # a repeated member does no harm
        if len(held_k) and not over:
            yield from _groups(held_k, held_f)
        elif over and len(held_k):
            yield _out(held_k, held_f.view(np.int64), None)

    def _groups(k, f):
        if not block:
            return links(k, f)
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(cut, len(k)))
        large = np.repeat(size > block, size)
        out = [_out(k[large], f[large].view(np.int64), None)] if large.any() else []
        return out + links(k[~large], f[~large])

    return run


def _out(k: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.ascontiguousarray(a)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.ascontiguousarray(b))], names=["k", "a", "b"])


def _linked(keyed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Links of the groups of (k, f) up to ``block`` members, and the rows (k, f) of the larger ones."""
    once = written(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_link(block), _LINKS))
    return once.where("b is not null").select("a", "b"), once.where("b is null").select("k", F.col("a").alias("f")).distinct()


def links(fps: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column ``simhash``, distinct) at four bits or fewer.

    A group of more than ``block`` different fingerprints under one key is divided once more: of five blocks of 13 bits
    close members share one. Only what is still above ``block`` then, fingerprints that are the same in most bits, is dealt
    out as pairs of blocks: about n / (block / 2) copies of each of its n members.
    """
    edges, large = _linked(fps.select("simhash").mapInArrow(_keyed, _KEYED), block)
    if large.isEmpty():
        return edges
    parts = F.explode(F.array(*[F.xxhash64("k", F.lit(i), F.shiftrightunsigned("f", 13 * i).bitwiseAND(0x1FFF)) for i in range(5)]))
    more, large = _linked(large.select(parts.alias("k"), "f"), block)
    edges = edges.unionAll(more)
    if large.isEmpty():
        return edges
    large = written(large)
    count = large.groupBy("k").agg(F.greatest(F.ceil(F.count("*") / F.lit(max(1, block // 2))), F.lit(2)).alias("m"), F.count("*").alias("n"))
    dealt = join_counted(large, count, ["k"], large.count()).withColumn("i", F.pmod(F.xxhash64("f"), F.col("m")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).where("i != j")
    dealt = dealt.select(F.xxhash64("k", F.least("i", "j"), F.greatest("i", "j")).alias("k"), "f")
    return edges.unionAll(dealt.repartition("k").sortWithinPartitions("k").mapInArrow(_link(None), _LINKS).select("a", "b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: its id, ``simhash`` and ``component_id``, the smallest id it reaches over links.

    Null and empty texts, and those of white space alone, have the fingerprint zero and are linked like any other.
    Rows may repeat; each is returned. A null id is returned but never a ``component_id`` beside other ids; a component
    without any id has a null one. Only the two named columns are read.
    """
    found = written(fingerprints(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__said")), text="__said", carry_text=False))
    fps = written(found.groupBy("simhash").agg(F.min("__id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(fps, block=block))
    rooted = written(fps.join(roots, fps.simhash == roots.node, "left").select("simhash", "least", "copies", F.coalesce("root", "simhash").alias("root")))
    sizes = rooted.agg(F.count("*").alias("prints"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = join_counted(rooted, named, ["root"], sizes.prints).select("simhash", "component_id", F.col("copies").alias("n"))
    return join_counted(found, classes, ["simhash"], sizes.rows).select(F.col("__id").alias(doc_id), "simhash", "component_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the smallest.

    Of rows that repeat an id one stays. Rows without an id cannot be told apart by one and all stay.
    """
    classes = written(near_duplicates(docs, doc_id=doc_id, text=text).where(F.col("component_id").isNotNull()).select(doc_id, "component_id"))
    kept = classes.select(F.col("component_id").alias(doc_id)).distinct()
    # the ids are hashed, not sorted with the texts
    named = docs.where(F.col(doc_id).isNotNull()).join(kept.hint("shuffle_hash"), doc_id, "left_semi")
    again = classes.where(F.col(doc_id) == F.col("component_id")).groupBy(doc_id).agg(F.count("*").alias("__n")).where("__n > 1").select(doc_id)
    if not again.isEmpty():
        named = named.join(again, doc_id, "left_anti").unionByName(named.join(again, doc_id, "left_semi").dropDuplicates([doc_id]))
    return named.unionByName(docs.where(F.col(doc_id).isNull()))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
