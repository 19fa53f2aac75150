"""Operator 7, suffix-array dedup: every byte that a repeated 200-byte string covers is removed.

The index (:mod:`.runindex`) is built in many small blocks, and only over text that can repeat:

1. Every 200-byte window has an owner, the least hash of its 32-byte grams. Windows that are equal have equal owners,
   so a window can repeat only if its owner does. Runs of windows with one owner are *pieces*; owners are counted.
2. Pieces whose owner occurs twice or more are cut out of their texts. Equal pieces are collapsed to one with a count.
3. Pieces are dealt out by owner, so that all places of a window meet, and a run-length index of each block of owners
   streams the matching statistics and gives the windows that occur elsewhere. A piece counted twice or more repeats as
   a whole. An owner with more places than a block holds is not indexed as one: its pieces are cut once more, by the least
   of other hashes of their windows' grams, and dealt out by both; and so on. What is left after ``LEVELS`` cuts, windows
   that are the same in nearly every gram, is compared window by window.
4. The spans go back to the texts, are merged, and what remains is hashed.

Texts are shuffled twice (the second time only those with such pieces), short ones never. Copies of one text, places of one
owner and places of one piece are joined such that a hot one is no bottleneck. Nothing is collected, and a list never
holds more than one text has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import PARTS, join_counted
from .common import chunks, mix, read_table, removed, scratch, small_batches, text_bytes, written
from .runindex import RunIndex

LENGTH = 200
_GRAM = 32
#: Windows of a piece at most; a periodic text has one owner for all of them.
_LONGEST = 512
#: Bytes of pieces that are indexed together.
BLOCK_BYTES = 1 << 20
#: Places of one owner that are indexed together at most: about as many bytes as a block has.
OWNER_PLACES = BLOCK_BYTES // (LENGTH + _LONGEST)
#: How often the pieces of an owner with more places are cut again.
LEVELS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECES = "h long, c long, d long, e long, at long, n long, big boolean, piece binary"
_SPANS = "h long, c long, n long, spans array<int>"
_PARTS = "k long, q long, h long, c long, off int, n long, piece binary"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each 32-byte gram, doubling the length with each step."""
    h = data.astype(np.uint64) + np.uint64(1)
    width, base = 1, _ODD
    while width < _GRAM:
        h = h[:-width] * base + h[width:]
        width, base = 2 * width, np.uint64(int(base) * int(base) % (1 << 64))
    return mix(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def _near_twice(grams: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray | None:
    """Windows around two places, less than a longest piece apart, where the same hash owns windows; None if there are none."""
    tallest = np.concatenate((np.zeros(width - 1, np.uint64), owner, np.zeros(width - 1, np.uint64)))
    owning = np.flatnonzero(~_least(~tallest, width) == grams)  # the tallest of the owners of the windows with this gram
    value = grams[owning]
    pair = (value[1:] == value[:-1]) & (np.diff(owning) < _LONGEST + width)
    if not pair.any():
        return None
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, np.maximum(owning[:-1][pair] - width + 1, 0), 1)
    np.add.at(change, np.minimum(owning[1:][pair] + 1, len(owner)), -1)
    return np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))


def pieces_of(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, owner, first window and number of windows of each piece of consecutive texts, and whether it may repeat in itself."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offs)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return none, none, none, none, none.astype(bool)
    width = length - _GRAM + 1
    grams = _gram_hashes(data)
    owner = _least(grams, width)  # of the window from each byte on
    inside = np.zeros(len(owner) + 1, np.int8)
    np.add.at(inside, offs[rows], 1)
    np.add.at(inside, offs[rows + 1] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    start = np.ones(len(owner), bool)
    start[1:] = owner[1:] != owner[:-1]
    start[offs[rows]] = True
    start &= inside
    first = np.flatnonzero(start)
    row = np.searchsorted(offs, first, "right") - 1
    last = np.append(first[1:], len(owner))
    last = np.minimum(last, offs[row + 1] - length + 1)
    count = last - first
    parts = -(-count // _LONGEST)
    if (parts > 1).any():
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last, row = np.repeat(first, parts) + nth * _LONGEST, np.repeat(last, parts), np.repeat(row, parts)
        count = np.minimum(last - first, _LONGEST)
    near = _near_twice(grams, owner, width)
    itself = np.zeros(len(first), bool) if near is None else near[first + count] > near[first]
    return row, owner[first].view(np.int64), first - offs[row], count, itself


def _owners(length: int):
    """Owner and place of each piece; twice, if the piece may repeat in itself. A place is the first window, then ten bits for their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            d, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for a, b in chunks(offs):
                row, h, at, n, itself = pieces_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], length)
                row, h, at, n = (np.concatenate((x, x[itself])) for x in (row, h, at, n))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d[a + row]), pa.array(e[a + row]), pa.array((at << 10) | n)], names=["h", "d", "e", "p"])

    return run


def _digest(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece) - (1 << 63)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(x, arrow[k]) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _batched(rows: Iterator[tuple], schema: str, size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes by ``size(row)``."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held > 4 << 20:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _cut(length: int):
    """Pieces of each text at its places."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text, d, e, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                said = text.encode()
                for place in places:
                    at = place["p"] >> 10
                    piece = said[at : at + (place["p"] & 0x3FF) + length - 1]
                    yield place["h"], _digest(piece), d, e, at, 1, place["big"], piece

    return lambda batches: _batched(pieces(batches), _PIECES, lambda row: len(row[-1]) + 64)


def _index(length: int, block_bytes: int):
    """Over rows (h, c, n, piece) sorted by h: the spans of windows of each piece that occur elsewhere too."""

    def spans(rows: list[tuple]) -> Iterator[tuple]:
        found = dict(RunIndex([r[3] for r in rows], length).repeated())
        for i, r in enumerate(rows):
            if r[2] > 1:
                yield *r[:3], [0, len(r[3]) - length + 1]
            elif i in found:
                yield *r[:3], found[i].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > block_bytes and row[0] != held[-1][0]:
                    yield from spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from spans(held)

    return lambda batches: _batched(run(batches), _SPANS, lambda row: 40 + 4 * len(row[3]))


def _cut_again(length: int, level: int):
    """Pieces (h, c, n, piece) cut where the least of other gram hashes of the windows changes."""
    salt = np.uint64((0xD1B54A32D192ED03 * (2 * level + 1)) % (1 << 64))
    width = length - _GRAM + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for h, c, n, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                owner = _least(mix(_gram_hashes(np.frombuffer(piece, np.uint8)) ^ salt), width)
                cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
                both = mix(owner[cuts[:-1]] ^ np.uint64(h % (1 << 64))).view(np.int64).tolist()
                for a, b, key in zip(cuts[:-1].tolist(), cuts[1:].tolist(), both, strict=True):
                    part = piece[a : b + length - 1]
                    yield key, _digest(part), h, c, a, n, part

    return lambda batches: _batched(parts(batches), _PARTS, lambda row: len(row[-1]) + 64)


def _windows(length: int):
    """Single windows of pieces, by a 128-bit hash."""
    schema = "h long, c long, n long, i int, w binary"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for h, c, n, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for i in range(len(piece) - length + 1):
                    yield h, c, n, i, hashlib.blake2b(piece[i : i + length], digest_size=16).digest()

    return schema, lambda batches: _batched(windows(batches), schema, lambda row: 100)


def repeated_windows(cut: DataFrame, *, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, owner_places: int = OWNER_PLACES, levels: int = LEVELS, level: int = 0) -> DataFrame:
    """(h, c, n, spans) of the distinct pieces that have a window which occurs elsewhere.

    ``cut`` has rows (h, c, n, piece, big): owner, hash and bytes of a piece, how often it stands there, and whether its
    owner has more than ``owner_places`` rows. ``n`` of the result is the sum over the rows of the piece.
    """

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))

    spans = once(cut.where("NOT big")).repartition("h").sortWithinPartitions("h", "c").mapInArrow(_index(length, block_bytes), _SPANS)
    hot = cut.where("big")
    if hot.isEmpty():
        return spans
    spans, hot = written(spans), once(hot).select("h", "c", "n", "piece")
    if level == levels:  # every window on its own: equal ones meet by their hash and are counted before they are shuffled
        schema, windows = _windows(length)
        single = written(hot.mapInArrow(windows, schema))
        again = written(single.groupBy("w").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).where("times > 1").select("w", "rows"))
        there = join_counted(single, again, ["w"], single.count(), "rows").select("h", "c", "n", F.array("i", F.col("i") + 1).alias("spans"))
    else:
        part = written(hot.mapInArrow(_cut_again(length, level), _PARTS))
        total = part.count()
        owners = written(part.groupBy("k").agg(F.count("*").alias("rows")).select("k", "rows", (F.col("rows") > owner_places).alias("big")))
        again = join_counted(part, owners, ["k"], total, "rows").select(F.col("k").alias("h"), F.col("q").alias("c"), "n", "piece", "big")
        found = written(repeated_windows(written(again), length=length, block_bytes=block_bytes, owner_places=owner_places, levels=levels, level=level + 1))
        # n is at least the number of rows of a part, as each stands for one place or more
        found = found.select(F.col("h").alias("k"), F.col("c").alias("q"), F.col("n").alias("rows"), "spans")
        back = join_counted(part.select("k", "q", "h", "c", "n", "off"), found, ["k", "q"], total, "rows")
        there = back.select("h", "c", "n", F.transform("spans", lambda x: x + F.col("off")).alias("spans"))
    return spans.unionByName(there.groupBy("h", "c").agg(F.first("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans")))


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _removed(text: str, flat: list[list[int]] | None, ats: list[int] | None, length: int) -> tuple[list[int], bytes]:
    said = text.encode()
    spans = _merged([[at + a, at + b + length - 1] for at, s in zip(ats or (), flat or (), strict=True) for a, b in zip(s[::2], s[1::2], strict=True)])
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(said[at:lo])
        at = hi
    kept.append(said[at:])
    return [x for s in spans for x in s], b"".join(kept)


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, owner_places: int = OWNER_PLACES, **limits) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``removed`` (flat byte spans, end exclusive) and ``kept_sha256``.

    Texts are judged as UTF-8 bytes; a span may cut a character. A null text is empty; one under ``length`` bytes has
    no window. Copies of a text cover each other. Rows may repeat and ids may be null. Only the two named columns are read.
    Texts are told apart by two 64-bit hashes. ``limits`` goes to :func:`repeated_windows`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.octet_length(said).cast("bigint")
    rows = docs.where(size >= length).select(F.col(doc_id).alias("__id"), said.alias("text"), size.alias("n_bytes"), F.xxhash64(said).alias("d"), F.xxhash64(F.lit("check"), said).alias("e"))
    short = docs.where(size < length).select(F.col(doc_id).alias("__id"), size.alias("n_bytes"), F.sha2(said, 256).alias("whole"))
    once = scratch(spark)
    owners = written(rows.select("text", "d", "e").mapInArrow(_owners(length), "h long, d long, e long, p long"), once)
    total = owners.count()
    twice = owners.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").withColumn("big", F.col("n") > owner_places)
    places = join_counted(owners, twice, ["h"], total).groupBy("d", "e").agg(F.collect_set(F.struct("h", "p", "big")).alias("places"))
    # a text has one first piece, so its copies are counted there; those of a hot text are spread over ``m`` tasks
    copies = owners.where(F.col("p") < 1 << 10).groupBy("d", "e").agg(F.count("*").alias("n"))
    bound = max(64, total // PARTS)
    hot = written(copies.where(F.col("n") > bound).select("d", "e", F.ceil(F.col("n") / bound).cast("int").alias("m")))  # as many rows as PARTS at most; so are the sums of m

    def for_all_copies(side: DataFrame) -> DataFrame:
        spread = side.join(F.broadcast(hot), ["d", "e"], "left")
        return spread.withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1))).drop("m")

    lot = F.pmod(F.xxhash64("__id", F.spark_partition_id(), F.monotonically_increasing_id()), F.coalesce("m", F.lit(1))).cast("int")
    found = rows.join(F.broadcast(hot), ["d", "e"], "left").withColumn("s", lot).drop("m").join(for_all_copies(places), ["d", "e", "s"], "left")
    found = written(found.select("__id", "d", "e", "s", "n_bytes", F.when(F.col("places").isNull(), F.sha2("text", 256)).alias("whole"), F.when(F.col("places").isNotNull(), F.col("text")).alias("text"), "places"))
    some = found.where("places is not null")
    cut = written(some.select("text", "d", "e", "places").mapInArrow(_cut(length), _PIECES))
    removed(spark, once)
    spans = written(repeated_windows(cut.select("h", "c", "n", "piece", "big"), length=length, owner_places=owner_places, **limits))
    back = join_counted(cut.select("h", "c", "d", "e", "at").distinct(), spans, ["h", "c"], cut.count())
    per_text = for_all_copies(back.groupBy("d", "e").agg(F.collect_list(F.struct("at", "spans")).alias("marks")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_removed(*row, length) for row in zip(*(batch.column(i).to_pylist() for i in (1, 3, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in done], pa.list_(pa.int64())), pa.array([hashlib.sha256(k).hexdigest() for _, k in done], pa.string())], names=["row", "removed", "kept_sha256"])

    marked = some.select("d", "e", "s", "__id", "n_bytes", "text").join(per_text, ["d", "e", "s"], "left")
    row = T.StructType([T.StructField("__id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType())])
    made = T.StructType([T.StructField("row", row), T.StructField("removed", T.ArrayType(T.LongType())), T.StructField("kept_sha256", T.StringType())])
    ends = marked.select(F.struct("__id", "n_bytes").alias("row"), "text", F.col("marks.at").alias("ats"), F.col("marks.spans").alias("flat")).mapInArrow(finish, made).select("row.*", "removed", "kept_sha256")
    untouched = found.where("places is null").select("__id", "n_bytes", "whole").unionByName(short)
    untouched = untouched.select("__id", "n_bytes", F.array().cast("array<bigint>").alias("removed"), F.col("whole").alias("kept_sha256"))
    return untouched.unionByName(ends).withColumnRenamed("__id", doc_id)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(read_table(spark, sf_dir, "documents"))
    signed = F.transform("removed", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_removed = F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), (F.size("removed") / 2).cast("bigint").alias("n_spans"), "kept_sha256")
