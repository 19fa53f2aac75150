"""Operator 13, hard-negative mining: exact searches over k-means inverted lists with stored centroid radii.

Vectors are cut to whole numbers, so scores are exact. A k-means over a bounded sample gives the centroids; every row goes
to the list of its nearest one, and lists are written in blocks of rows of one cluster and label, with the block's radius
(greatest distance of a row to the centroid). By Cauchy-Schwarz, a row x of a block with centroid m and radius r has
``a.m - |a| r <= a.x <= a.m + |a| r`` for an anchor a: the first clusters are visited in the order of the upper bound until
some rows are at hand, and of the others only those whose upper bound does not fall strictly below the kth best score so
far (ties are decided by the id, so an equal bound is visited) and whose bounds meet the window of scores asked for. Bounds
leave room for rounding. Anchors come in waves of bounded size, each a broadcast; a wave reads the lists once for the
first clusters and once for the others, once for the positives and once for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, scratch, small_batches, written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows (and bytes) the centroids are fitted on at most, rows that a cluster should have, and clusters at most.
SAMPLE, SAMPLE_BYTES, PER_CLUSTER, CLUSTERS, STEPS = 65_536, 32 << 20, 256, 4096, 8
#: Rows of a block, and anchors (and bytes of them) of a wave.
BLOCK, WAVE, WAVE_BYTES = 4096, 8192, 16 << 20
#: Clusters that are visited first, as a part of all.
FIRST = 1 / 16
#: Squared lengths from here on are no exact doubles, or no longs.
EXACT, LARGEST = float(1 << 53), float(1 << 62)
_NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v: floor(scale * x) of each component, as doubles.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do those whose cut vector
    has a squared length of 2**62 or more, as scores would be no longs.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    cut = rows.where(sound).select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
    return cut.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c) < LARGEST))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def fit_centroids(sample: np.ndarray, clusters: int, steps: int = STEPS) -> np.ndarray:
    """Lloyd's algorithm from rows spread over the sample; a cluster that loses all rows keeps its place."""
    centers = sample[np.linspace(0, len(sample) - 1, clusters).astype(np.int64)].copy()
    for _ in range(steps):
        near = _nearest(sample, centers)
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(clusters))
        many = np.bincount(near, minlength=clusters)
        has = many > 0
        centers[has] = np.add.reduceat(sample[order], first[has], axis=0) / many[has, None]
    return centers


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(half - rows[i : i + BLOCK] @ centers.T).argmin(1) for i in range(0, len(rows), BLOCK)]])


def build_lists(rows: DataFrame, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Blocks (cell, label, radius, ids, vectors as bytes) of all rows of :func:`whole_vectors`; the centroids and their radii.

    The centroids are fitted on ``SAMPLE`` rows (or ``SAMPLE_BYTES``) at most, drawn by a hash of id and vector; all rows are
    indexed. A cluster with far more rows than others is dealt out in parts.
    """
    spark = rows.sparkSession
    small_batches(spark)
    known = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    n, width = known.n, max(1, known.width)
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * width)))
    drawn = rows.select("v", F.xxhash64("vec_id", "v", F.lit(seed)).alias("h"))
    if n > 2 * most:  # more than enough rows on average, then the first of them
        drawn = drawn.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * 1.5 * most / n) + 1)
    sample = _matrix(pa.array([r.v for r in drawn.orderBy("h").limit(most).collect()], pa.list_(pa.float64())), width)
    clusters = int(min(CLUSTERS, max(1, n // PER_CLUSTER), max(1, len(sample) // 8)))
    centers = fit_centroids(sample, clusters) if len(sample) else np.zeros((1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column(2), width), centers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "label", "v", "cell"])

    placed = written(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])))
    share = max(512, 2 * n // len(centers))
    parts = F.broadcast(placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / share).alias("parts")))  # CLUSTERS rows at most
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).select("cell", "part", "label", "vec_id", "v")
    sorted_rows = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "label", "vec_id")
    names = ["cell", "label", "radius", "ids", "vectors"]
    schema = T.StructType([placed.schema["cell"], placed.schema["label"], T.StructField("radius", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            x = np.concatenate([v for _, v in held])
            far = float(np.sqrt(((x - centers[key[0]]) ** 2).sum(1)).max())
            kind = next((k for k in ("<i2", "<i4") if np.abs(x).max(initial=0) < 2.0 ** (8 * int(k[2]) - 1)), "<f8")  # whole doubles
            return (key[0], key[2], far, np.concatenate([i for i, _ in held]).tobytes(), kind.encode() + x.astype(kind).tobytes())

        key, held, size, out = None, [], 0, []
        for batch in batches:
            cell, part = (batch.column(i).to_numpy() for i in (0, 1))
            label, ids, v = batch.column(2).to_pylist(), batch.column(3).to_numpy(), _matrix(batch.column(4), width)
            i = 0
            while i < len(ids):
                here = (int(cell[i]), int(part[i]), label[i])
                if held and (here != key or size >= BLOCK):
                    out.append(flush(held))
                    held, size = [], 0
                key, j = here, i + 1
                while j < len(ids) and size + j - i < BLOCK and (int(cell[j]), int(part[j]), label[j]) == key:
                    j += 1
                held.append((ids[i:j], v[i:j]))
                size, i = size + j - i, j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(flush(held), strict=True), kinds, strict=True)], names=names)

    kinds = [pa.int32(), pa.string() if isinstance(schema["label"].dataType, T.StringType) else pa.int64(), pa.float64(), pa.binary(), pa.binary()]
    if kinds[1] == pa.int64():
        schema["label"].dataType = T.LongType()
    lists, radii = written(sorted_rows.mapInArrow(block, schema)), np.zeros(len(centers))
    for r in lists.groupBy("cell").agg(F.max("radius").alias("r")).collect():  # CLUSTERS rows at most
        radii[r.cell] = r.r
    return lists, centers, radii


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where any sum stays below 2**53, else in longs."""
    if np.sqrt((a * a).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0)) < EXACT / 2:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class _Best:
    """The best ``k`` (score, id) of each slot; ``least`` is the score that one more has to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.parts, self.size = [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((slot, score, ids))
        self.size += len(slot)
        if self.size > 200_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        slot, score, ids = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in self.parts]]) for i in range(3))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept, last = nth < self.k, nth == self.k - 1
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        self.parts, self.size = [(slot[kept], score[kept], ids[kept])], int(kept.sum())
        return self.parts[0]


def _search(lists: DataFrame, centers: np.ndarray, anchors: dict, asked: dict, k: int, same: bool, near: np.ndarray, first: bool) -> list:
    """One pass over the lists for a wave: (slot, score, id) of the best ``k`` of each slot of the clusters that are visited.

    ``asked``: for each slot the number of its anchor (ascending), the least and the greatest score, and the score to reach.
    ``near``: as bits, which clusters each anchor visits first; the pass is over these or over the others.
    """
    shared = lists.sparkSession.sparkContext.broadcast((centers, anchors, asked, near))  # of bounded size, see WAVE and CLUSTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, anchors, asked, near = shared.value
        a, owner, high = anchors["v"], asked["owner"], asked["high"]
        length, labels, names = np.sqrt((a * a).sum(1)), anchors["label"], anchors["vec_id"]
        best, width = _Best(np.maximum(asked["low"], asked["reach"]), k), centers.shape[1]
        for batch in batches:
            for cell, label, radius, ids, packed in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                m = centers[cell]
                middle = a @ m
                room = 1.0 + 1e-9 * length * (np.sqrt(m @ m) + radius + 1)
                reach = length * radius + room
                wanted = ((labels == label) == same) & ((near[:, cell >> 3] >> (7 - (cell & 7)) & 1 == 1) == first)
                # the bound of the block against the kth score and the window, for each slot
                open_ = wanted[owner] & ((middle + reach)[owner] >= best.least) & ((middle - reach)[owner] <= high)
                slots = np.flatnonzero(open_)
                if not len(slots):
                    continue
                x = np.frombuffer(packed, packed[:3].decode(), offset=3).reshape(-1, width).astype(np.float64)
                here = np.frombuffer(ids, "<i8")
                who = np.unique(owner[slots])
                for b in range(0, len(who), 256):
                    part = who[b : b + 256]
                    score = _scores(a[part], x)
                    mine = slots[(owner[slots] >= part[0]) & (owner[slots] <= part[-1])]
                    table = score[np.searchsorted(part, owner[mine])]
                    fits = (table >= best.least[mine][:, None]) & (table <= high[mine][:, None])
                    if same:
                        fits &= here[None, :] != names[owner[mine]][:, None]
                    many = fits.sum(1)
                    for i in np.flatnonzero(many > 4 * k).tolist():  # few of many: those that reach the kth of the block
                        values = np.where(fits[i], table[i], _NONE)
                        fits[i] &= table[i] >= np.partition(values, len(values) - k)[len(values) - k]
                    row, col = np.nonzero(fits)
                    best.add(mine[row], table[row, col], here[col])
        slot, score, ids = best.settle()
        for i in range(0, len(slot), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in (slot, score, ids)], names=["slot", "score", "id"])

    found = lists.mapInArrow(run, "slot long, score long, id long")
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k)
    out = ranked.select("slot", "score", "id").toPandas()  # k rows of each slot of a wave at most
    shared.destroy()
    return [out[c].to_numpy(np.int64) for c in ("slot", "score", "id")]


def _two_rounds(lists, centers, anchors, low, high, owner, k, same, near):
    """The best ``k`` of each slot over all clusters, by score and id."""
    asked = {"owner": owner, "low": low, "high": high, "reach": np.full(len(owner), _NONE)}
    best = _Best(asked["reach"], k)
    best.add(*_search(lists, centers, anchors, asked, k, same, near, True))
    best.settle()
    asked["reach"] = best.least.copy()
    best.add(*_search(lists, centers, anchors, asked, k, same, near, False))
    return best.settle()


def mine_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor and positive the best negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables have the form that :func:`whole_vectors` returns. An anchor's positives are the first rows of its label with
    another id, by falling score and then id; a positive's negatives are the first rows of other labels with ``low`` to
    ``high`` hundredths of its score (none if it is negative). Shorter vectors are filled up with zeros. An id that several
    anchor rows have is an anchor once for each different row; a row that is there twice counts twice among the others. An
    empty table gives an empty one. Exact: no cluster is left out but by its bounds.
    """
    spark = rows.sparkSession
    lists, centers, radii = build_lists(rows)
    width = centers.shape[1]
    wave = max(1, min(WAVE, WAVE_BYTES // (8 * width)))
    chosen = written(anchors.dropDuplicates(["vec_id", "label", "v"]).withColumn("label", F.col("label").cast(lists.schema["label"].dataType)))
    waves = max(1, -(-chosen.count() // wave))
    dealt = written(chosen.withColumn("wave", F.pmod(F.xxhash64("vec_id", "v"), F.lit(waves)).cast("int")))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path, ceiling = scratch(spark), np.iinfo(np.int64).max
    spark.createDataFrame([], schema).write.parquet(f"{path}/wave=-1")
    for w in range(waves):
        # about WAVE rows, by the hash
        table = dealt.where(F.col("wave") == w).orderBy("vec_id", "label", "v").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        v = _matrix(table["v"].combine_chunks(), width)
        here = {"v": v, "vec_id": table["vec_id"].to_numpy(), "label": np.array(table["label"].to_pylist())}
        n = len(v)
        upper = v @ centers.T + np.sqrt((v * v).sum(1))[:, None] * radii
        few = max(1, int(np.ceil(len(centers) * FIRST)))
        near = np.packbits(upper >= -np.partition(-upper, few - 1, axis=1)[:, few - 1 : few], axis=1)  # decided once, for both passes
        everyone = np.arange(n)
        owner, score, ids = _two_rounds(lists, centers, here, np.full(n, _NONE), np.full(n, ceiling), everyone, positives, True, near)
        # 100 * negative between low and high times the positive; a whole number between the rounded bounds
        whole, rest = np.divmod(score, 100)  # scores may be large
        least, most = low * whole - (-low * rest // 100), high * whole + high * rest // 100
        slot, found, negative = _two_rounds(lists, centers, here, least, most, owner, negatives, False, near)
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot) + 1
        columns = [here["vec_id"][owner[slot]], ids[slot], rank.astype(np.int32), negative, score[slot], found]
        made = pa.table([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
        spark.createDataFrame(made, schema).write.parquet(f"{path}/wave={w}")
    return spark.read.schema(schema).parquet(f"{path}/wave=*")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(read_table(spark, sf_dir, "embeddings"), label=label)
    return mine_negatives(rows, rows.where("vec_id % 100 = 0"))


#: The same rows by comparing every anchor with every row.
OP13_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM clean a JOIN clean r ON a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 10
"""
