"""Hashed word n-grams and logistic regression by the follow-the-regularised-leader update (FTRL-proximal)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, lists, mix, small_batches, text_bytes
from .words import scan

#: Width of the hashed feature space.
BITS = 18
_PAIR = np.uint64(0xA0761D6478BD642F)
_SAME = np.uint64(0xE7037ED1A0B428DB)


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slot and row of every n-gram, and the number of n-grams of each row.

    Tokens are words and runs of punctuation; features are single tokens and pairs of neighbours. A pair that
    repeats one token is one feature of its own, whatever the token. Values are counts over the row's n-grams.
    """
    tokens = scan(data, offs, punctuation=True)
    h, row = tokens.hash, tokens.row
    pair = row[1:] == row[:-1]
    left, right = h[:-1][pair], h[1:][pair]
    pairs = np.where(left == right, _SAME, mix(left * _PAIR ^ right))
    slots = (np.concatenate((h, mix(pairs))) >> np.uint64(64 - bits)).astype(np.int64)
    rows = np.concatenate((row, row[1:][pair]))
    return slots, rows, np.bincount(rows, minlength=len(offs) - 1)


def train_ftrl(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) from examples in the given order; per-coordinate rates."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(labels)):
            i, x = slots[k], values[k]
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


#: A row's mean over its n-grams is small; this brings the values near one.
SCALE = 10.0


_COUNTED = T.StructType([T.StructField("label", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("said", T.LongType()), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("n", T.LongType())])


def _features_of(bits: int):
    """Rows (label, rank, hash of the text, text) as distinct slots, their counts and the number of n-grams: bounded by the feature space, however long the text."""

    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(3))
            for a, b in chunks(offs):
                slot, row, count = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bits)
                key, times = np.unique(row * (1 << bits) + slot, return_counts=True)
                per = np.bincount(key >> bits, minlength=b - a)
                slots = lists((key & ((1 << bits) - 1)).astype(np.int32), per, pa.int32())
                times = lists(times.astype(np.int32), per, pa.int32())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), slots, times, pa.array(count.astype(np.int64))], names=_COUNTED.fieldNames())

    return run


def fit(labelled: DataFrame, *, per_class: int, bits: int = BITS, epochs: int = 3) -> tuple[list[str], np.ndarray | None]:
    """Classes in order and their weights (one against the rest), from columns ``label``, ``text``, ``rank`` (a hash that orders the rows).

    At most ``per_class`` rows of each label are used, the first by ``rank``. What the one fitting task holds is bounded by
    it: a row is its hashed features by then, at most ``2**bits`` of them. The number of classes must be small, as each gets
    a weight vector. No rows: no classes and None. A single class gives a bias alone.
    """
    labelled = labelled.where("label is not null").select(F.col("label").cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text"), "rank")
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).collect()
    if not counts:
        return [], None
    classes = sorted(r.label for r in counts)
    # rank is an even 64-bit hash, so a threshold a little above the wanted share leaves few rows for the top-k
    share = {r.label: min(1.0, (per_class + 6 * per_class**0.5 + 10) / r.n) for r in counts}
    keep = F.lit(False)
    for label, part in share.items():
        keep = keep | ((F.col("label") == label) & (F.col("rank") <= int(-(2**63) + min(part * 2**64, 2**64 - 1))))
    small_batches(labelled.sparkSession)
    hashed = labelled.where(keep).select("label", "rank", F.xxhash64("text").alias("said"), "text").mapInArrow(_features_of(bits), _COUNTED)
    few = hashed.groupBy("label", "rank").agg(F.min_by(F.struct("slots", "times", "n"), "said").alias("x")).select("label", "rank", "x.slots", "x.times", "x.n")  # copies of a row count once

    def train(batches):
        rows: list[tuple] = []
        for batch in batches:
            slots, times = batch.column(2), batch.column(3)
            for i, (label, rank, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)), strict=True)):
                rows.append((rank, label, np.append(slots[i].values.to_numpy(), 1 << bits).astype(np.int64), np.append(times[i].values.to_numpy() * (SCALE / max(1, n)), 1.0)))
        rows.sort(key=lambda r: r[:2])
        taken: dict[str, int] = {}
        first = []
        for row in rows:
            taken[row[1]] = taken.get(row[1], 0) + 1
            if taken[row[1]] <= per_class:
                first.append(row)
        if first:
            slots, values = [r[2] for r in first], [r[3] for r in first]
            w = [train_ftrl(slots, values, np.array([float(r[1] == c) for r in first]), bits=bits, epochs=epochs) for c in classes]
            yield pa.RecordBatch.from_pydict({"w": [x.tobytes() for x in w], "i": list(range(len(w)))}, schema=pa.schema([("w", pa.binary()), ("i", pa.int32())]))

    got = few.coalesce(1).mapInArrow(train, T.StructType([T.StructField("w", T.BinaryType()), T.StructField("i", T.IntegerType())])).collect()
    return classes, np.stack([np.frombuffer(bytes(r.w), np.float32) for r in sorted(got, key=lambda r: r.i)])


def margins(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sparse dot products: one margin for each row and class."""
    data, offs = text_bytes(texts)
    out = []
    for a, b in chunks(offs):
        slot, row, count = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bits)
        sums = np.stack([np.bincount(row, w[slot], minlength=b - a) for w in weights], axis=1)
        out.append(weights[:, -1] + sums * (SCALE / np.maximum(1, count))[:, None])
    return np.concatenate(out) if out else np.zeros((0, len(weights)))
