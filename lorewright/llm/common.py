"""Shared plumbing of the training-data operators: scratch tables, column carrying, Arrow text chunks.

Conventions that every operator of this subpackage keeps:

* An operator reads only the columns it names. Other columns are carried through untouched; where a
  carried column has the name of an output column (letter case aside), the output column wins.
* A null text counts as the empty text unless the operator's docstring says otherwise.
* Intermediate results that must survive a lost executor are written as Parquet below
  ``spark.checkpoint.dir`` (see :mod:`lorewright.store`), never kept by localCheckpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import removed, scratch, written

__all__ = ["carried", "chunks", "is_held_out", "lists", "map_text", "mix", "read_table", "removed", "scratch", "small_batches", "text_bytes", "written"]

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 18
#: Rows of a batch that goes to Python; with texts of some kilobytes, a few megabytes on either side.
BATCH_ROWS = 1000
#: Text bytes of a batch that goes back to the JVM at once.
SLICE_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: the usual 10,000 rows are tens of megabytes in the JVM and again in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def carried(df: DataFrame, made: list[str]) -> list[str]:
    """The columns of ``df`` that no column in ``made`` replaces."""
    taken = {name.lower() for name in made}
    return [c for c in df.columns if c.lower() not in taken]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], made: T.StructType, carry_text: bool = True, binary: bool = False) -> DataFrame:
    """Add columns computed from a text column (or a binary one), one Arrow batch after another, without a shuffle.

    ``make()`` runs once per task and returns a function from the batch's text array to one array for each
    field of ``made``. Without ``carry_text`` the text column itself does not come back from Python.
    """
    keep = [c for c in carried(df, made.fieldNames()) if c != text]
    given = F.col(f"`{text}`")
    source = df.select((given if binary else given.cast("string")).alias("__text"), *[df[f"`{c}`"] for c in keep])
    keeps_text = carry_text and text.lower() not in {n.lower() for n in made.fieldNames()}
    fields = ([T.StructField(text, T.BinaryType() if binary else T.StringType())] if keeps_text else []) + [source.schema[c] for c in keep] + made.fields
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in _slices(batches):
            columns = ([batch.column(0)] if keeps_text else []) + [batch.column(i + 1) for i in range(len(keep))]
            columns += work(batch.column(0))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    small_batches(df.sparkSession)
    out = source.mapInArrow(run, schema)
    order = [c for c in df.columns if c in set(keep) or (c == text and keeps_text)]
    return out.select(*[f"`{c}`" for c in order], *[f"`{n}`" for n in made.fieldNames()])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``SLICE_BYTES`` in the first column, a string or binary, without copying."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        for a, b in chunks(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), SLICE_BYTES):
            yield batch.slice(a, b - a)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 row offsets of a string array; a null row is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    start, n = 0, len(offs) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def lists(values: np.ndarray | pa.Array, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    flat = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def is_held_out(doc_id: str = "doc_id"):
    """The hold-out rule of the learned operators: crc32 of the id's text, mod 3, is 1 (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
