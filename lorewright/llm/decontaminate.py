"""Operator 8, benchmark decontamination: Wu-Manber search for many patterns at once, over words.

A pattern is a window of 13 consecutive words of a benchmark item (an item of fewer words, but not none, is
one shorter pattern). The alphabet of the search is the word: for each pattern length a shift table, indexed by
a block of two neighbouring words, tells how far the search may jump; where the shift is zero, a bucket of
patterns that end in this block, and of those the ones with the same first word, are looked up, and the words themselves
are compared. All segments of a chunk of texts advance in step, so that every jump is one numpy gather.

The documents are read in one pass and never shuffled. Patterns are arrays: the benchmark's words in a row, and the places
where windows begin, sorted by the codes of their last block and first word. They come in blocks of at most about
``block_bytes`` of benchmark text (a longer item is a block of its own). The driver fetches and builds one block at a time;
a task holds one block at a time beside a few megabytes of texts, and takes these through all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, chunks, lists, map_text, mix, read_table, text_bytes
from .words import Tokens, scan

WINDOW = 13
#: Word positions that one lane of the search owns.
SEGMENT = 128
#: Slots of a shift table as a power of two: least and most.
SHIFT_BITS = (16, 22)
#: Benchmark text of a block.
BLOCK_BYTES = 4 << 20
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of consecutive texts: bytes (A-Z lower-cased), span, hash, and the first word of each text."""

    def __init__(self, texts: pa.Array):
        data, offs = text_bytes(texts)
        parts: list[Tokens] = []
        first, lower, at = [], [], 0
        for a, b in chunks(offs):
            t = scan(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            first.append(np.searchsorted(t.row, np.arange(b - a), "left") + at)
            at += len(t.hash)
            t.start, t.end = t.start + offs[a], t.end + offs[a]
            lower.append(t.lower)
            parts.append(t)
        self.lower = np.concatenate([*lower, np.zeros(8, np.uint8)])  # eight bytes more, so that eight may be read at each place
        self.start, self.end = (np.concatenate([getattr(t, name) for t in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for name in ("start", "end"))
        self.hash = np.concatenate([t.hash for t in parts] or [np.zeros(0, np.uint64)])
        self.first = np.append(np.concatenate([*first, np.zeros(0, np.int64)]), at).astype(np.int64)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number, the first byte the lowest."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, m: int) -> np.ndarray:
    """Whether the ``m`` words of ``a`` from each of ``i`` on are, byte for byte, those of ``b`` from ``j`` on."""
    same = np.ones(len(i), bool)
    for k in range(m):
        live = np.flatnonzero(same)
        if not len(live):
            break
        x, y = i[live] + k, j[live] + k
        size = a.end[x] - a.start[x]
        equal = size == b.end[y] - b.start[y]
        left, right = a.start[x], b.start[y]
        for at in range(0, int(size[equal].max(initial=0)), 8):
            look = np.flatnonzero(equal & (size > at))
            if not len(look):
                break
            rest = np.minimum(size[look] - at, 8).astype(np.uint64)
            equal[look] = (_eight(a.lower)[left[look] + at] ^ _eight(b.lower)[right[look] + at]) << (np.uint64(64) - np.uint64(8) * rest) == 0
        same[live] = equal
    return same


class Patterns:
    """Shift tables and suffix buckets of the windows of one block of benchmark items (id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = {name: n for n, name in enumerate(self.ids)}
        owner = np.array([number[i] for i, _ in items], np.int64)
        self.words = Words(pa.array([t for _, t in items], pa.large_string()))
        size = np.diff(self.words.first)
        self.tables: list[_Table] = []
        for m in np.unique(np.minimum(size[size > 0], window)).tolist():
            mine = np.flatnonzero(np.minimum(size, window) == m)
            count = size[mine] - m + 1
            place = np.repeat(self.words.first[mine], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            self.tables.append(_Table(m, self.words, place, np.repeat(owner[mine], count)))

    def occurrences(self, said: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(first word, number of the item's id, words) of every occurrence in the texts, by pattern length."""
        for table in self.tables:
            yield *table.search(said, self.words), table.m


class _Table:
    def __init__(self, m: int, words: Words, place: np.ndarray, owner: np.ndarray):
        self.m, self.block = m, 1 if m == 1 else 2
        self.bits = int(np.clip(np.ceil(np.log2(max(1, 4 * m * len(place)))), *SHIFT_BITS))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint8 if m < 250 else np.int64)
        for last in range(self.block - 1, m):
            code = self._code(words.hash, place + last)
            np.minimum.at(self.shift, code, m - 1 - last)
        key = self._key(code, words.hash[place])
        order = np.argsort(key, kind="stable")
        self.keys, self.place, self.owner = key[order], place[order], owner[order].astype(np.int32)

    @staticmethod
    def _key(code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The bucket of a window: its last block, then its first word."""
        return (code.astype(np.uint64) << np.uint64(64 - SHIFT_BITS[1])) | (first >> np.uint64(SHIFT_BITS[1]))

    def _code(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        value = h[last] if self.block == 1 else mix(h[last - 1] * _FOLD ^ h[last])
        return (value >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, said: Words, known: Words) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        lo, hi = said.first[:-1] + self.m - 1, said.first[1:]  # last words that a window of each row can have
        rows = np.flatnonzero(lo < hi)
        if not len(rows):
            return none, none
        lo, hi = lo[rows], hi[rows]
        lanes = (hi - lo + SEGMENT - 1) // SEGMENT
        nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(lo, lanes) + nth * SEGMENT
        end = np.minimum(at + SEGMENT, np.repeat(hi, lanes))
        first, owner = [none], [none]
        while len(at):
            code = self._code(said.hash, at)
            step = self.shift[code].astype(np.int64)
            zero = step == 0
            if zero.any():
                place = at[zero] - self.m + 1
                key = self._key(code[zero], said.hash[place])
                a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                for cut in self._cuts(b - a):  # a bucket may be large; its candidates come in parts
                    x, y = self._bucket(a[cut], b[cut])
                    start = place[cut][x]
                    true = _same_words(said, start, known, self.place[y], self.m)
                    first.append(start[true])
                    owner.append(self.owner[y[true]].astype(np.int64))
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.concatenate(first), np.concatenate(owner)

    @staticmethod
    def _cuts(n: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
        for a, b in chunks(np.concatenate(([0], np.cumsum(n))), most):
            yield slice(a, b)

    @staticmethod
    def _bucket(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, member) of all members of the ranges."""
        n = b - a
        x = np.repeat(np.arange(len(n)), n)
        return x, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - a, n)


class _Found:
    """What the blocks found in a group of texts: the cover of its words, and the ids by row."""

    def __init__(self, texts: pa.Array):
        self.said = Words(texts)
        self.change = np.zeros(len(self.said.hash) + 1, np.int32)
        self.pairs: set[tuple[int, str]] = set()

    def look(self, patterns: Patterns) -> None:
        for first, owner, m in patterns.occurrences(self.said):
            np.add.at(self.change, first, 1)
            np.add.at(self.change, first + m, -1)
            row = np.searchsorted(self.said.first, first, "right") - 1
            both = np.unique(np.stack([row, owner], axis=1), axis=0)
            self.pairs.update((r, patterns.ids[o]) for r, o in both.tolist())

    def columns(self) -> list[pa.Array]:
        first, n = self.said.first, len(self.said.first) - 1
        hit = np.cumsum(self.change[:-1]) > 0
        before = np.concatenate(([False], hit[:-1]))
        edge = np.zeros(len(hit), bool)
        edge[first[:-1][first[:-1] < len(hit)]] = True  # a span does not go on in the next text
        start = np.flatnonzero(hit & (~before | edge))
        end = np.flatnonzero(np.append(hit[:-1] & (~hit[1:] | edge[1:]), hit[-1:])) + 1
        row = np.searchsorted(first, start, "right") - 1
        spans = np.stack([start - first[row], end - first[row]], axis=1).ravel()
        items = sorted(self.pairs)
        per = np.bincount(np.array([r for r, _ in items], np.int64), minlength=n)
        return [
            pa.array(np.diff(first), pa.int64()),
            lists(spans.astype(np.int64), 2 * np.bincount(row, minlength=n), pa.int64()),
            lists(pa.array([i for _, i in items], pa.string()), per, pa.string()),
        ]


_MADE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in blocks of bounded size; each is fetched on its own."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    if n == 1:
        yield [(r.item, r.text) for r in rows.collect()]
        return
    part = F.pmod(F.xxhash64("item", "text"), F.lit(2 * n))  # twice as many, as hashing fills them unevenly
    for i in range(2 * n):
        yield [(r.item, r.text) for r in rows.where(part == i).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (word spans, end exclusive, flat), ``items``, ``contaminated``.

    A word is hit if it lies inside an occurrence of a window; a document is contaminated if it has a hit word and
    at least one word in twenty is hit. Null or empty texts have no words and are not contaminated. Benchmark rows
    with a null id or text, or without a word, have no window. Repeated rows are judged one by one. Other columns
    are carried (the text only if ``carry_text``); a column named like one of the new ones is replaced. One item is never
    divided between blocks.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(Patterns(block, window)) for block in _blocks(benchmark, item, item_text, block_bytes)]  # the driver keeps them on its disk

    def make():
        one = shared[0].value if len(shared) == 1 else None

        def work(texts: pa.Array) -> list[pa.Array]:
            found = _Found(texts)
            if one is not None:
                found.look(one)
            else:
                for block in shared:
                    found.look(block.value)
                    if hasattr(block, "_path"):  # one block is in memory at a time; the next value is read from the executor's disk
                        vars(block).pop("_value", None)
            return found.columns()

        return work

    out = map_text(docs, text, make, _MADE, carry_text)
    signed = F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    out = out.withColumn("n_hit", F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, b: a + b))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    keep = [c for c in carried(docs, ["n_words", "n_hit", "hit_spans", "items", "contaminated"]) if carry_text or c != text]
    return out.select(*[f"`{c}`" for c in keep], "n_words", "n_hit", "hit_spans", "items", "contaminated")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), carry_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same rows from plain joins over exploded windows.
OP8_SQL = r"""
WITH docs AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
dw AS (
  SELECT doc_id, rid, w, i FROM (
    SELECT doc_id, rid,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM docs), unnest(ws) WITH ORDINALITY AS t(w, i)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS m, array_to_string(ws[s : s + least(len(ws), 13) - 1], ' ') AS p
  FROM bw, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(s) WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT rid, doc_id, i AS s, m, array_to_string(list(w) OVER (PARTITION BY rid, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)[1 : m], ' ') AS p,
         count(*) OVER (PARTITION BY rid, m ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS left_
  FROM dw, ms),
occ AS (SELECT rid, s, win.m AS m, item_id FROM win JOIN pat ON win.m = pat.m AND win.p = pat.p WHERE left_ >= win.m),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM occ, unnest(range(s, s + m)) AS t(k) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY rid),
nw AS (SELECT rid, count(*) AS n FROM dw GROUP BY rid)
SELECT d.doc_id, coalesce(nw.n, 0) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= coalesce(nw.n, 0) AS contaminated
FROM docs d LEFT JOIN nw USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
