"""Cells of vectors around centers: which cells a search or a join has to look at follows from distances alone.

Centers are fitted on a bounded sample, but every vector is in the cell of its nearest center, and each cell's radius is kept;
so a bound that passes a cell over is exact, whatever the centers are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..store import written

#: Vectors (and bytes of them) that the centers of a model are fitted on at most, and centers at most.
SAMPLE, SAMPLE_BYTES, CENTERS, STEPS = 16_384, 32 << 20, 1024, 5
#: Room for rounding in a bound on distances or cosines.
SLACK = 1e-6


def fitted(sample: np.ndarray, many: int) -> np.ndarray:
    """``many`` centers by Lloyd's algorithm, from rows spread over the sample; a center that no row is near stays."""
    centers = sample[np.linspace(0, len(sample) - 1, many).astype(np.int64)].copy()
    for _ in range(STEPS):
        near = distances(sample, centers).argmin(1)
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=many)
        np.add.at(sums, near, sample)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (centers * centers).sum(1) - 2 * rows @ centers.T
    return np.sqrt(np.maximum(squares, 0))


def centers_of(vectors: DataFrame, rows_of_a_cell: int) -> dict[str, np.ndarray]:
    """Centers of each model of (id, model, c), one for every so many rows; few models are expected."""
    sizes = {r.model: (r.n, r.width) for r in vectors.groupBy("model").agg(F.count("*").alias("n"), F.max(F.size("c")).alias("width")).collect()}
    width = max([1, *(w for _, w in sizes.values())])
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * width * max(1, len(sizes)))))
    first = Window.partitionBy("model").orderBy(F.xxhash64("id"), "id")
    drawn = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("model", "c").collect()
    out = {}
    for model, (n, _) in sizes.items():
        sample = np.array([r.c for r in drawn if r.model == model], np.float64)
        out[model] = fitted(sample, int(min(CENTERS, max(1, n // rows_of_a_cell), max(1, len(sample) // 4))))
    return out


def placed(vectors: DataFrame, centers: dict[str, np.ndarray]) -> DataFrame:
    """``vectors`` (id, model, c: array<double>) with the nearest center's number ``cell`` and the distance ``d``, written."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())])
    at, by = vectors.columns.index("c"), vectors.columns.index("model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for mine, rows, points in _models(batch, at, by, centers):
                far = distances(rows, points)
                cell[mine] = far.argmin(1)
                d[mine] = far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d)], names=schema.fieldNames())

    return written(vectors.mapInArrow(run, schema))


def _models(batch: pa.RecordBatch, at: int, by: int, centers: dict[str, np.ndarray]):
    models = np.array(batch.column(by).to_pylist(), object)
    vectors = batch.column(at)
    for model in set(models.tolist()):
        mine = np.flatnonzero(models == model)
        rows = vectors.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), -1)
        yield mine, rows, centers[model]


# SIM-01, JOI-13: pairs of close vectors


def _close(threshold: float):
    """Pairs of two blocks (side 0 and 1) of unit vectors, or of one block with itself, by one matrix product."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        alone = key[2] == 0 and key[3] == key[4]
        if alone:
            m = np.stack(left.c.to_numpy())
            right, product = left, np.triu(m @ m.T + 2.0, 1) - 2.0  # each pair once: what is below the diagonal is too small
        elif len(left) and len(right):
            product = np.stack(left.c.to_numpy()) @ np.stack(right.c.to_numpy()).T
        else:
            product = np.zeros((len(left), len(right)))
        i, j = np.nonzero(product >= threshold)
        x, y = left.id.to_numpy()[i], right.id.to_numpy()[j]
        first = x < y
        return pd.DataFrame({"a": np.where(first, x, y), "b": np.where(first, y, x), "model": key[0], "cosine": product[i, j]})

    return run


def meetings(vectors: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """Rows (id, model, c, cell, kind, p, q, side) of the blocks that meet: those of one cell (kind 0), visitors with a cell's (kind 1).

    With r the distance of unit vectors at the threshold: if x is in cell c and a vector within r of it is in cell e, x is no
    further from the center of e than its own distance plus 2 r (that vector is nearer to e than to c), and no further than
    the radius of e plus r. So x visits the cells of smaller number for which both hold, and no pair is met twice.
    """
    r = max((2 - 2 * threshold) ** 0.5, 1e-6)
    rows = vectors.select("id", "model", F.transform("c", lambda x: x.cast("double")).alias("c"))
    centers = centers_of(rows, max(1, block // 4))
    inside = placed(rows, centers)
    radii = {m: np.full(len(x), -np.inf) for m, x in centers.items()}
    counts = inside.groupBy("model", "cell").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    for row in counts.collect():  # CENTERS rows for each model at most
        radii[row.model][row.cell] = row.d
    schema = T.StructType([*inside.schema.fields, T.StructField("visits", T.ArrayType(T.IntegerType()))])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            out: list = [None] * batch.num_rows
            for mine, c, points in _models(batch, 2, 1, centers):
                model = batch.column(1)[int(mine[0])].as_py()
                reach = np.minimum(d[mine][:, None] + 2 * r, radii[model] + r) + SLACK
                goes = (distances(c, points) <= reach) & (np.arange(len(points)) < cell[mine][:, None])
                for i, line in zip(mine.tolist(), goes, strict=True):
                    out[i] = np.flatnonzero(line).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.fieldNames())

    rows = written(inside.mapInArrow(visits, schema))
    coming = rows.select("model", F.explode("visits").alias("cell")).groupBy("model", "cell").agg(F.ceil(F.count("*") / block).alias("v"))
    blocks = counts.select("model", "cell", F.ceil(F.col("n") / block).alias("m")).join(coming, ["model", "cell"], "left").fillna(0, ["v"])
    blocks = F.broadcast(written(blocks))  # CENTERS rows for each model at most

    def each(count, key):
        return F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), count), lambda j: j < count), key)

    def key(kind: int, p, q, side):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"))

    i = F.pmod(F.xxhash64("id"), F.col("m"))
    own = F.concat(each(F.col("m"), lambda j: key(0, F.least(i, j), F.greatest(i, j), i > j)), each(F.col("v"), lambda w: key(1, w, i, F.lit(1))))
    met = rows.join(blocks, ["model", "cell"]).select("id", "model", "c", "cell", F.explode(own).alias("k"))
    w = F.pmod(F.xxhash64("id", F.lit(1)), F.col("v"))
    going = rows.select("id", "model", "c", F.explode("visits").alias("cell")).join(blocks, ["model", "cell"])
    met = met.unionByName(going.select("id", "model", "c", "cell", F.explode(each(F.col("m"), lambda j: key(1, w, j, F.lit(0)))).alias("k")))
    return met.select("id", "model", "c", "cell", "k.*")


def cosine_pairs(vectors: DataFrame, threshold: float = 0.92, block: int = 4096) -> DataFrame:
    """SIM-01, JOI-13: pairs (a, b, model, cosine) of unit vectors (id, model, c) of one model with a cosine of ``threshold`` or more.

    Vectors meet by the cells of :func:`meetings`, compared as blocks of matrices of about ``block`` rows, which bounds
    what a task holds. Exact. How much is passed over depends on the data: vectors in clusters meet their own cluster, vectors
    spread evenly over many dimensions all meet.
    """
    return meetings(vectors, threshold, block).groupBy("model", "cell", "kind", "p", "q").applyInPandas(_close(threshold), "a string, b string, model string, cosine double")


# RET-04: a kept index


class VectorCells:
    """Vectors of chunks in folders of cells; a search reads the folders that can hold a hit."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.rows = path, spark.read.parquet(f"{path}/rows")
        self.directory = spark.read.parquet(f"{path}/directory")

    @staticmethod
    def keep(chunks: DataFrame, path: str, rows_of_a_cell: int = 256) -> VectorCells:
        """``chunks`` (memory_id, embedding, model); those without a vector, or with a zero one, have no similarity and are left out."""
        c = F.transform("embedding", lambda x: x.cast("double"))
        rows = chunks.select(F.col("memory_id").alias("id"), "model", c.alias("e")).withColumn("norm", N.norm(F.col("e"))).where("norm > 0 AND model IS NOT NULL")
        units = rows.select("id", "model", F.transform("e", lambda x: x / F.col("norm")).alias("c"), "e")
        centers = centers_of(units, rows_of_a_cell)
        inside = placed(units, centers)
        inside.select(F.col("id").alias("memory_id"), F.col("e").alias("embedding"), "model", "cell").repartitionByRange("model", "cell", "memory_id").write.partitionBy("model", "cell").parquet(f"{path}/rows")
        spark = chunks.sparkSession
        table = [(m, i, [float(v) for v in x]) for m, points in centers.items() for i, x in enumerate(points)]
        points = spark.createDataFrame(table, "model string, cell int, center array<double>")
        inside.groupBy("model", "cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).join(points, ["model", "cell"]).write.parquet(f"{path}/directory")
        return VectorCells(spark, path)

    def _read(self, model: str, cells: list[int]) -> DataFrame:
        return self.rows.where((F.col("model") == model) & F.col("cell").isin(cells))

    def leg(self, query_vector: list[float], model: str, keep: DataFrame | None = None) -> tuple[DataFrame, float]:
        """The rows of :func:`.search.vector_leg`, and the share of the model's vectors that were in the cells read.

        By Cauchy-Schwarz no cosine in a cell is above ``u.center + radius``. The cells of the highest bounds give a first best
        hit; the band below the best one only rises with it, so cells whose bound is below that band hold no row of the leg.
        """
        from .search import vector_leg

        q = np.array(query_vector, np.float64)
        size = float(np.linalg.norm(q))
        cells = [r for r in self.directory.where(F.col("model") == model).collect()]  # CENTERS rows at most
        if not cells or not size > 0:
            return vector_leg(self.rows, query_vector, model, keep), 1.0
        upper = {r.cell: float(q @ np.array(r.center)) / size + r.radius + SLACK for r in cells}
        order = sorted(upper, key=lambda c: (-upper[c], c))
        first = vector_leg(self._read(model, order[: max(1, len(order) // 16)]), query_vector, model, keep).agg(F.max("top")).first()[0]
        bound = 0.0 if first is None or first <= 0 else min(first, max(N.VECTOR_FLOOR, first * N.VECTOR_BAND))
        wanted = [c for c in order if upper[c] >= bound]
        share = sum(r.n for r in cells if r.cell in set(wanted)) / sum(r.n for r in cells)
        return vector_leg(self._read(model, wanted), query_vector, model, keep), share
