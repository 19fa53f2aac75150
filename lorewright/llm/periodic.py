"""Operator 11, periodic run detection: repeated k-gram masking, then Main-Lorentz over the segments that are left.

A run is a stretch of words with smallest period q that is at least ``max(min_words, min_repeats * q)`` long and that no
neighbouring word extends. Two copies of a run, q words apart, overlap in ``max(min_words, min_repeats * q) - q`` words, at
least k for any q (16 for 24 words and three repeats). So each word of a run stands in a k-gram that occurs twice in its
document; all other words are masked, and few segments are left of ordinary prose. Main-Lorentz divides a segment in halves
again and again: a run belongs to the smallest part that holds it, crosses that part's middle, and has a whole period on
one side of it, so the words at the middle and one period away are compared, for all periods of all parts of one depth at
once, and extended to both sides. Words are numbered and grams ranked exactly (no hash decides a result).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, lists, map_text, mix, read_table, text_bytes
from .words import _powers

MIN_WORDS, MIN_REPEATS = 24, 3
#: Text bytes whose words are looked at together; a longer text is looked at as a whole.
BLOCK_BYTES = 1 << 20
#: Pairs of places that are compared at once.
PAIRS = 1 << 20
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
#: Fixed value: a word is a stretch without these characters.
WORD = r"[^\x20\x09-\x0D]+"


def overlap(min_words: int, min_repeats: int) -> int:
    """The least number of words that a run shares with itself moved by its period."""
    near = min_words // min_repeats
    return min(max(min_words, min_repeats * q) - q for q in (max(1, near), near + 1))


def number_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words (equal words, equal numbers) and the n+1 row offsets among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(gap[1:], gap[:-1], out=cut[1:])
    cut[offs[offs < n]] = True
    at = np.flatnonzero(cut)
    ends = np.append(at, n).astype(np.int64)
    tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    ids = tiles.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    word = ~gap[at]
    start = at[word]
    return ids[word].astype(np.int64), np.searchsorted(start, offs)


def survivors(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Which words stand in a k-gram that occurs twice in their row; equal hashes let more stand, never less."""
    n = len(ids)
    live = np.zeros(n, bool)
    if n < k + 1:
        return live
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    gram = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
    whole = row[: n - k + 1] == row[k - 1 :]
    key = gram ^ mix(row[: n - k + 1].astype(np.uint64) + np.uint64(7))
    at = np.flatnonzero(whole)
    key = key[at]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return live
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = at[twice[place] == key]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + k, -1)
    return np.cumsum(marks[:n]) > 0


class _Ranks:
    """Numbers of the 2**j-grams of segments; equal grams, equal numbers; -1 where a gram would leave its segment.

    Segments stand one after the other with a slot between them that no gram holds.
    """

    def __init__(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.start = np.concatenate(([1], 1 + np.cumsum(length + 1)))[:-1]
        self.origin = np.repeat(start - self.start, length)
        total = int(length.sum()) + len(length) + 1
        where = np.repeat(self.start, length) + (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))
        left = np.zeros(total, np.int64)
        left[where] = np.repeat(self.start + length, length) - where
        first = np.full(total, -1, np.int32)
        first[where] = np.unique(ids[where + self.origin], return_inverse=True)[1]
        self.levels = [first]
        at, size = where, 1
        while True:
            at = at[left[at] >= 2 * size]
            if not len(at):
                break
            last = self.levels[-1]
            key = last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + size]
            ranks = np.full(total, -1, np.int32)
            ranks[at] = np.unique(key, return_inverse=True)[1]
            self.levels.append(ranks)
            size *= 2
        self.total = total

    def equal(self, level: int, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        ranks = self.levels[level]
        inside = (i >= 0) & (k >= 0) & (i < self.total) & (k < self.total)
        a = ranks[np.where(inside, i, 0)]
        return (a >= 0) & (a == ranks[np.where(inside, k, 0)])

    def forward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Words that agree from i and k on."""
        n = np.zeros(len(i), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            n += self.equal(j, i + n, k + n).astype(np.int64) << j
        return n

    def backward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Words that agree up to i and k, these included."""
        n = np.zeros(len(i), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            back = n + (1 << j) - 1
            n += self.equal(j, i - back, k - back).astype(np.int64) << j
        return n


def _parts(size: np.ndarray, limit: int):
    """Ranges of items whose sizes sum up to about ``limit``."""
    return chunks(np.concatenate(([0], np.cumsum(size))), limit)


def find_runs(ids: np.ndarray, start: np.ndarray, length: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs of the segments of ``ids``, by start and then period (Main-Lorentz)."""
    least = max(min_words, min_repeats)
    long = length >= least
    start, length = start[long], length[long]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    ranks = _Ranks(ids, start, length)
    half = -(-overlap(min_words, min_repeats) // 2)  # one of the two extensions has so many words
    level = min(half.bit_length() - 1, len(ranks.levels) - 1)
    size = 1 << level
    lo, hi = ranks.start, ranks.start + length
    found = [np.zeros((0, 3), np.int64)]
    while len(lo):
        middle = (lo + hi) // 2
        periods = (hi - lo) // min_repeats
        for a, b in _parts(periods, PAIRS):
            many = periods[a:b]
            m = np.repeat(middle[a:b], many)
            q = np.arange(len(m)) - np.repeat(np.cumsum(many) - many, many) + 1
            for left, right in ((m, m + q), (m - q, m)):
                near = ranks.equal(level, left, right) | ranks.equal(level, left - size, right - size)
                x, y, p = left[near], right[near], q[near]
                after, before = ranks.forward(x, y), ranks.backward(x - 1, y - 1)
                total = after + before + p
                keep = total >= np.maximum(min_words, min_repeats * p)
                found.append(np.stack([(x - before)[keep], total[keep], p[keep]], 1))
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
        lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):  # a stretch has its multiples as periods, too: the smallest is the run's
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))]
        segment = np.searchsorted(ranks.start, runs[:, 0], "right") - 1
        runs[:, 0] += start[segment] - ranks.start[segment]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs


def runs_of_rows(ids: np.ndarray, rows: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs of the rows' words, starts counted over all rows."""
    live = survivors(ids, rows, overlap(min_words, min_repeats))
    edge = np.zeros(len(ids) + 1, bool)
    edge[rows] = True
    edge[1:-1] |= live[1:] != live[:-1]
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    left = live[start] if len(start) else np.zeros(0, bool)
    return find_runs(ids, start[left], (end - start)[left], min_words, min_repeats)


def collapse_runs(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, carry_text: bool = True) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start and then period) and ``collapsed``.

    ``collapsed`` has the words that are left, joined by one space: a word goes if a run holds it after the run's first
    period. Words are stretches without ASCII white space, letter case counts. ``min_repeats`` is 2 or more. A null text
    counts as empty: no runs, an empty ``collapsed``. Rows are looked at one by one, so repeated rows give repeated rows;
    ``runs`` and ``collapsed`` of the input are replaced, other columns are carried, and an empty table stays empty. No
    shuffle. A text is looked at as a whole, however long: about 60 bytes for each of its words, and for those in segments
    4 bytes more for each doubling of the longest segment.
    """
    if min_repeats < 2 or min_words < 1:
        raise ValueError("a run needs min_repeats of 2 or more and min_words of 1 or more")

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            data, offs = text_bytes(texts)
            runs, counts, kept = [], [], []
            for a, b in chunks(offs, BLOCK_BYTES):
                part = data[offs[a] : offs[b]]
                ids, rows = number_words(part, offs[a : b + 1] - offs[a])
                here = runs_of_rows(ids, rows, min_words, min_repeats)
                owner = np.searchsorted(rows, here[:, 0], "right") - 1
                keep = np.zeros(len(ids) + 1, np.int64)
                np.add.at(keep, here[:, 0] + here[:, 2], 1)
                np.add.at(keep, here[:, 0] + here[:, 1], -1)
                keep = np.cumsum(keep) == 0
                here[:, 0] -= rows[owner]
                runs.append(here)
                counts.append(np.bincount(owner, minlength=b - a))
                has = counts[-1] > 0
                for i in range(b - a):
                    words = part[offs[a + i] - offs[a] : offs[a + i + 1] - offs[a]].tobytes().split()  # at ASCII white space
                    kept.append(b" ".join(itertools.compress(words, keep[rows[i] : rows[i + 1]].tolist()) if has[i] else words))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            made = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=RUN.fieldNames())
            return [lists(made, np.concatenate([np.zeros(0, np.int64), *counts]), made.type), pa.array(kept, pa.binary()).cast(pa.string())]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]), carry_text)


def _planted(doc_id: Column, text: Column) -> Column:
    """The text as it is, but in a tenth of the documents its words repeat from some word on, with a period drawn from the id."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def moved(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (F.lit(1) + a + (i - a) % p).cast("int")))), " ")

    # the words are an element of an array here so that they are cut once
    repeated = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, moved(w)).otherwise(text)), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), repeated).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the run with the greatest exact length by period is found by cross-multiplication."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = collapse_runs(docs, carry_text=False)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best)

    best = F.aggregate("runs", none, better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    made = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    ratio = F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("bigint")
    return made.select("doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"), ratio.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
