"""MTH-08: keys that any two similar sets share one of, without counts over all sets.

Two sets of a Jaccard similarity above t differ in fewer than (1-t)/(1+t) times the sum of their sizes. If both are divided
by their elements' hashes into more parts than that, one part at least is the same in both; its hash is the key. The number
of parts depends on the class of a set's size: classes are such that similar sets are in one class or in neighbouring ones,
so a set has the keys of its own class and of the next. A part is empty in some sets; there are a few parts more for that,
and a set with more empty parts than those has keys of its empty parts too. So no similar pair is lost at any threshold; the
keys tell sets apart well while parts have some elements, which is so above 0.8.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST, BITS = 1 << 31, 1024


@cache
def size_classes(threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the classes, their numbers of parts and how many of these may be empty."""
    least = [1]
    while least[-1] < LARGEST:
        least.append(max(least[-1] + 1, int(np.ceil(least[-1] / threshold - 1e-9))))
    largest = np.array([n - 1 for n in least[1:]], float)
    differ = np.floor((1 - threshold) / (1 + threshold) * 2 * largest + 1e-9).astype(np.int64)
    spare = np.where(differ > 0, 1 + differ // 25, 0)
    return np.array(least[:-1]), differ + 1 + spare, spare


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(elements: np.ndarray, sizes: np.ndarray, classes: np.ndarray, threshold: float) -> pa.ListArray:
    _, parts, spare = size_classes(threshold)
    number = parts[classes]
    starts = np.cumsum(number) - number
    row = np.repeat(np.arange(len(sizes)), sizes)
    hashed = _mixed(elements)
    at = starts[row] + (hashed % number[row].astype(np.uint64)).astype(np.int64)
    sums, filled = np.zeros(number.sum(), np.uint64), np.bincount(at, minlength=number.sum()) > 0
    np.add.at(sums, at, _mixed(hashed ^ np.uint64(0x9E3779B97F4A7C15)))
    of = np.repeat(np.arange(len(sizes)), number)
    place = (np.arange(len(of)) - starts[of]).astype(np.uint64) + (classes[of].astype(np.uint64) << np.uint64(32))
    empty = np.bincount(of, weights=~filled, minlength=len(sizes))
    kept = filled | (empty > spare[classes])[of]
    keys = _mixed(sums ^ _mixed(place + np.uint64(1)))[kept]
    offsets = np.append(0, np.cumsum(np.bincount(of, weights=kept, minlength=len(sizes)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))


def _odd(elements: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    at = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (_mixed(elements) >> np.uint64(32)).astype(np.int64) % BITS
    odd = np.packbits((np.bincount(at, minlength=len(sizes) * BITS) & 1).astype(np.uint8))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) + 1, dtype=np.int32) * (BITS // 64)), pa.array(odd.view(np.int64)))


def may_be_similar(na: Column, a: Column, nb: Column, b: Column, threshold: float) -> Column:
    """False only for sets that are not similar: they differ in as many elements as their bits at least."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return differ < (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6


def part_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, bits, own, next): keys of sets (id, s: array of distinct 64-bit hashes), of those that are not empty. Two similar
    sets share a key, and in one of them at least it is of its ``own`` class. ``bits``: which of 1,024 groups of elements
    the set has an odd number of, for :func:`may_be_similar`."""
    least = size_classes(threshold)[0].tolist()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1000):
                batch = whole.slice(first, 1000)
                batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column("s")), 0), False))
                if not len(batch):
                    continue
                sizes = pc.list_value_length(batch.column("s")).to_numpy().astype(np.int64)
                elements = batch.column("s").flatten().to_numpy().view(np.uint64)
                classes = np.array([bisect_right(least, n) - 1 for n in sizes.tolist()])
                own, after = (_keys(elements, sizes, c, threshold) for c in (classes, classes + 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes.astype(np.int32)), _odd(elements, sizes), own, after], ["id", "n", "bits", "own", "next"])

    return sets.select("id", "s").mapInArrow(made, "id string, n int, bits array<bigint>, own array<bigint>, next array<bigint>")
