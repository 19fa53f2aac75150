"""Operator 5, language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, is_held_out, map_text, read_table, small_batches

#: n-grams of a profile, and those of a document that are compared with it.
RANKS = 300
#: Characters of a longer text that are counted at once.
BLOCK_CHARS = 1 << 20
_EDGE = 0x110000  # stands for the space between words; no code point
_GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
_UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters than letters is one edge. Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[points] if len(points) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate(([_EDGE], np.where(letter, points, _EDGE), [_EDGE]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _EDGE) | (points[:-1] != _EDGE)
    return points[keep]


def _ngrams(codes: np.ndarray) -> np.ndarray:
    """1- to 3-grams of letters and edges, packed; an edge is no 1-gram and no middle of a 3-gram."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    pairs = codes[:-1] | (codes[1:] + 1) << 21
    return np.concatenate((codes[codes != _EDGE], pairs, (a | (b + 1) << 21 | (c + 1) << 42)[b != _EDGE]))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts; by direct addressing where the alphabet is small."""
    there = np.unique(codes) if len(codes) < 1 << 16 else np.flatnonzero(np.bincount(codes))
    size = len(there)
    if not size or size > 160 or len(codes) < size**3 // 8:
        if not size:
            return codes, codes
        return np.unique(_ngrams(codes), return_counts=True)
    small = np.searchsorted(there, codes)
    one = np.bincount(small, minlength=size)
    two = np.bincount(small[:-1] * size + small[1:], minlength=size * size)
    three = np.bincount((small[:-2] * size + small[1:-1]) * size + small[2:], minlength=size**3)
    x, y, z = np.flatnonzero(one), np.flatnonzero(two), np.flatnonzero(three)
    first, middle, last = there[z // (size * size)], there[z // size % size], there[z % size]
    grams = [there[x], there[y // size] | (there[y % size] + 1) << 21, first | (middle + 1) << 21 | (last + 1) << 42]
    uses = [there[x] != _EDGE, np.ones(len(y), bool), middle != _EDGE]
    return np.concatenate([g[u] for g, u in zip(grams, uses, strict=True)]), np.concatenate([n[u] for n, u in zip((one[x], two[y], three[z]), uses, strict=True)])


def _long_counted(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_counted(_codes(text))``, over blocks of ``size`` characters: memory follows the block and the n-grams."""
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = np.array([_EDGE], np.int64)
    said = False
    for start in range(0, len(text), size):
        part = text[start : start + size]
        points = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = _letters()[points]
        said |= bool(letter.any())
        points = np.concatenate((tail, np.where(letter, points, _EDGE), np.full(int(start + size >= len(text)), _EDGE)))
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != _EDGE) | (points[:-1] != _EDGE)
        keep[: len(tail)] = True
        codes, old = points[keep], len(tail)
        # n-grams that end in this block; the codes of the block before are there for their beginnings
        one, two, three = codes[old:], codes[max(0, old - 1) :], codes[max(0, old - 2) :]
        triples = (three[:-2] | (three[1:-1] + 1) << 21 | (three[2:] + 1) << 42)[three[1:-1] != _EDGE]
        new, m = np.unique(np.concatenate((one[one != _EDGE], two[:-1] | (two[1:] + 1) << 21, triples)), return_counts=True)
        merged, at = np.unique(np.concatenate((grams, new)), return_inverse=True)
        grams, n = merged, np.bincount(at, np.concatenate((n, m))).astype(np.int64)
        tail = codes[-2:]
    return (grams, n) if said else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def counted(text: str, size: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; none without a letter."""
    return _long_counted(text, size) if len(text) > size else _counted(_codes(text))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language of each few megabytes of text, added up in the task while they are few."""
    held: dict[str, dict[int, int]] = {}

    def flush():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts.keys()), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            into = held.setdefault(lang, {})
            sizes = np.cumsum([0, *map(len, texts)])
            for a, b in chunks(sizes):
                grams, n = counted("\n".join(texts[a:b]))
                for g, k in zip(grams.tolist(), n.tolist(), strict=True):
                    into[g] = into.get(g, 0) + k
        if sum(map(len, held.values())) > 500_000:
            yield from flush()
    yield from flush()


def train_profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, in order (ties: the smaller packed n-gram), over all rows given.

    Rows with a null language or text teach nothing. What is fetched is ``ranks`` numbers for each language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    small_batches(docs.sparkSession)
    counts = rows.mapInArrow(_count_grams, _GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= ranks)
    found: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "r").collect():
        found.setdefault(row.lang, []).append(row.gram)
    return found


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS):
        self.langs, self.ranks = sorted(profiles), ranks
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.place = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: n-grams of no profile
        for i, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.grams, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, n = counted(text) if text and self.langs else (np.zeros(0, np.int64),) * 2
        if not len(grams):
            return _UNKNOWN, 0.0
        top = grams[np.lexsort((grams, -n))[: self.ranks]]
        at = np.searchsorted(self.grams, top)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == top
        place = self.place[np.where(known, at, len(self.grams))]
        apart = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.ranks * len(top))


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, text: str = "text", ranks: int = RANKS, carry_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (one less the out-of-place distance, as a share of the largest one).

    Whole texts are ranked. A null text, one without a letter, or any text where no language was learned, is ``und``
    with score 0. Languages at the same distance: the first by name. Other columns are carried; those two are replaced.
    Texts of any length are counted in blocks of characters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # ``ranks`` numbers for each language

    def make():
        known = Profiles(shared.value, ranks)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [known.predict(t) for t in texts.to_pylist()]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), carry_text)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = train_profiles(docs.where(~is_held_out()))
    return identify(docs.select("doc_id", "text"), profiles, carry_text=False).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
