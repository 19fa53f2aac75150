"""STM-06: an inverted index that takes inserts, edits and deletes, as runs of postings that are merged when they are read.

Each batch of changes is a run: posting lists of the notes it puts, an entry for each note that it puts or drops (an entry
without a length is a tombstone), and its numbers as signed deltas. A posting counts if no later run has an entry for its
note. Runs are named by the first and the last batch in them; a run is there once its numbers are, which are written last,
so a batch that was cut off leaves nothing and one that comes again changes nothing. A batch's texts are read once and
never shuffled: tasks count the tokens of some notes at a time and emit them as a block, with a list of places in it for
each term, and only these lists are dealt to the folders of term buckets. :meth:`DeltaIndex.compact` merges neighbouring runs of like size, so there are few
runs and each posting is written again a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..store import removed, scratch, written
from .index import BUCKETS, _of_terms, bucket_of, folded

#: A row is a list of postings of one term, which are places in a block of notes, or, in the folder ``ENTRIES`` and with no
#: term, the block itself; there ``tfs`` has the number of a note's distinct terms.
_LISTS = "term string, block string, places array<int>, tfs array<int>, ids array<string>, lengths array<int>, lives array<boolean>"
_ROWS = "term string, id string, length int, live boolean, tf long"
_NUMBERS = "docs long, length long, postings long"
ENTRIES = -1
#: A task counts about so many tokens at a time; a merged list has about so many postings.
FLUSH, LIST = 1 << 20, 1 << 16


@dataclass(frozen=True, order=True)
class Run:
    """The batches ``first`` to ``last``."""

    first: int
    last: int
    path: str


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of notes (id, live, tokens; no tokens for a note that is dropped), of about ``FLUSH`` tokens at a time."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += len(batch.column("tokens").flatten())
        if tokens >= FLUSH:
            yield from _flushed(pa.Table.from_batches(held))
            held, tokens = [], 0
    if held and any(b.num_rows for b in held):
        yield from _flushed(pa.Table.from_batches(held))


def _flushed(notes: pa.Table) -> Iterator[pa.RecordBatch]:
    notes = notes.combine_chunks()
    ids, lives, tokens = (notes.column(c).combine_chunks() if c != "tokens" else pa.concat_arrays(notes.column(c).chunks) for c in ("id", "live", "tokens"))
    n, lengths = len(ids), pc.list_value_length(tokens)
    words = tokens.flatten().dictionary_encode()
    keys = words.indices.to_numpy().astype(np.int64) * n + pc.list_parent_indices(tokens).to_numpy()
    keys, tf = np.unique(keys, return_counts=True)
    code, row = keys // n, keys % n
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
    terms = words.dictionary.take(pa.array(code[starts])).cast(pa.string())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (row, tf)]
    none = {c: pa.list_(t) for c, t in (("ids", pa.string()), ("lengths", pa.int32()), ("lives", pa.bool_()))}
    block = ids[0].as_py()  # a note is in one block of a run
    yield pa.RecordBatch.from_arrays([terms, pa.array([block] * len(terms), pa.string()), *lists, *[pa.nulls(len(terms), t) for t in none.values()]], [*_NAMES])
    whole, terms_of = pa.array([0, n], pa.int32()), pa.array(np.bincount(row, minlength=n).astype(np.int32))
    notes_of = [pa.ListArray.from_arrays(whole, v) for v in (terms_of, ids.cast(pa.string()), lengths.cast(pa.int32()), lives)]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block], pa.string()), pa.nulls(1, pa.list_(pa.int32())), *notes_of], [*_NAMES])


_NAMES = ("term", "block", "places", "tfs", "ids", "lengths", "lives")


def _notes(blocks: DataFrame) -> DataFrame:
    """(block, place, id, length, live, terms) of blocks of notes."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "lengths", "lives", "tfs")).alias("place", "p"))
    return each.select("block", "place", F.col("p.ids").alias("id"), F.col("p.lengths").alias("length"), F.col("p.lives").alias("live"), F.col("p.tfs").cast("bigint").alias("terms"))


def _rows(lists: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lists meet their block as a whole, so no posting is shuffled."""
    notes = blocks.select("block", F.arrays_zip("ids", "lengths", "lives").alias("notes"))
    found = lists.select("term", "block", F.arrays_zip("places", "tfs").alias("p")).join(notes, "block")
    each = found.select("term", F.explode(F.transform("p", lambda p: F.struct(F.get("notes", p["places"]).alias("n"), p["tfs"].cast("bigint").alias("tf")))).alias("x"))
    return each.select("term", F.col("x.n.ids").alias("id"), F.col("x.n.lengths").alias("length"), F.col("x.n.lives").alias("live"), F.col("x.tf").alias("tf"))


def _listed(rows: DataFrame, entries: DataFrame, parts: Column) -> DataFrame:
    """Rows (term, id, length, live, tf) and entries (id, length, live, terms) as lists, in blocks by a hash of the id."""
    block = F.pmod(F.xxhash64("id"), parts).cast("string").alias("block")
    p = F.array_sort(F.collect_list(F.struct("id", "length", "live", F.col("terms").cast("int").alias("terms"))))
    blocks = entries.groupBy(block).agg(p.alias("p"))
    blocks = blocks.select(F.lit(None).cast("string").alias("term"), "block", F.lit(None).cast("array<int>").alias("places"), F.col("p.terms").alias("tfs"), F.col("p.id").alias("ids"), F.col("p.length").alias("lengths"), F.col("p.live").alias("lives"))
    blocks = written(blocks)
    placed = rows.join(_notes(blocks).select("id", "block", "place"), "id").groupBy("term", "block")
    lists = placed.agg(F.array_sort(F.collect_list(F.struct("place", F.col("tf").cast("int").alias("tf")))).alias("p"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<string>"), ("lengths", "array<int>"), ("lives", "array<boolean>"))]
    return lists.select("term", "block", F.col("p.place").alias("places"), F.col("p.tf").alias("tfs"), *none).unionByName(blocks)


def write_lists(lists: DataFrame, path: str) -> None:
    """Write lists to the folders of their buckets, sorted by term. A folder's lists are dealt to as many tasks as the
    session's number of shuffle partitions has times the number of folders."""
    tasks = -(-int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    bucket = F.when(F.col("term").isNull(), ENTRIES).otherwise(bucket_of(F.col("term")))
    dealt = lists.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(tasks)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def counted_lists(notes: DataFrame) -> DataFrame:
    """The lists of notes (id, live, tokens)."""
    return notes.mapInArrow(_counted, _LISTS)


def write_counted(notes: DataFrame, path: str) -> None:
    """Write the lists of notes (id, live, tokens)."""
    write_lists(counted_lists(notes), path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_LISTS}, bucket int").parquet(path)


def postings_of(lists: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, id, length, live, tf) of the ``terms``, or of all."""
    found = lists.where(F.col("bucket") != ENTRIES) if terms is None else _of_terms(lists, terms, keep=True)
    return _rows(found, lists.where(F.col("bucket") == ENTRIES))


def postings_of_table(lists: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`postings_of` for a table (term) of distinct terms, and (term, df); lists of other terms are left out first."""
    found = lists.where(F.col("term").isNotNull()).join(terms, "term", "left_semi")
    return _rows(found, lists.where(F.col("bucket") == ENTRIES)), found.groupBy("term").agg(F.sum(F.size("places")).alias("df"))


def entries_of(lists: DataFrame) -> DataFrame:
    return _notes(lists.where(F.col("bucket") == ENTRIES))


class DeltaIndex:
    """An index below a folder; it answers what a :class:`.index.WordIndex` answers. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # runs

    def _all(self) -> list[Run]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path
        top = where(f"{self.path}/runs")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        done = [n for n in names if fs.exists(where(f"{self.path}/runs/{n}/numbers/_SUCCESS"))]
        return [Run(*map(int, n.split("-")), f"{self.path}/runs/{n}") for n in done]

    def runs(self) -> list[Run]:
        """The runs that count, oldest first: none that another one holds."""
        out: list[Run] = []
        for run in sorted(self._all(), key=lambda r: (r.first, -r.last)):
            if not out or run.last > out[-1].last:
                out.append(run)
        return out

    def _postings(self, run: Run) -> DataFrame:
        return read_lists(self.spark, f"{run.path}/postings")

    def _blocks(self, run: Run) -> DataFrame:
        return self._postings(run).where(F.col("bucket") == ENTRIES)

    def _entries(self, runs: list[Run]) -> DataFrame:
        """(id, length, live, terms, run): what the runs say of their notes."""
        out = self.spark.createDataFrame([], "id string, length int, live boolean, terms long, run long")
        for run in runs:
            out = out.unionAll(_notes(self._blocks(run)).select("id", "length", "live", "terms", F.lit(run.first).cast("bigint")))
        return out

    @staticmethod
    def _newest(entries: DataFrame) -> DataFrame:
        return entries.groupBy("id").agg(F.max_by(F.struct("length", "live", "terms"), "run").alias("e")).select("id", "e.*")

    def _written(self, run: Run, lists: DataFrame) -> DataFrame:
        """Write the run's lists; its entries."""
        removed(self.spark, run.path)  # what a try that was cut off has left
        write_lists(lists, f"{run.path}/postings")
        return self._entries([run])

    def _commit(self, run: Run, numbers: DataFrame) -> None:
        numbers.coalesce(1).write.parquet(f"{run.path}/numbers")  # a single row

    # changes

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch; False if it is there already. Batches are numbered upwards, as a stream's are.

        ``changes`` has ``op`` (``put`` or ``drop``), the columns of a note (``id``, ``title``, ``content``, ``tags`` and, if
        there are deleted notes, ``deleted_at``) and, if a note may come twice, ``seq``: its last change counts. A note
        that is put again is replaced. Dropping a note that is not there does nothing; a null id is passed over.
        """
        runs = self.runs()
        if any(r.first <= batch <= r.last for r in runs):
            return False
        if runs and batch < runs[-1].last:
            raise ValueError(f"batch {batch} comes after batch {runs[-1].last}")
        put = F.col("op") == "put"
        live = F.col("deleted_at").isNull() if "deleted_at" in changes.columns else F.lit(True)
        texts = [F.when(put, F.col(c)).alias(c) for c in ("title", "content", "tags")]
        rows = changes.where(F.col("id").isNotNull()).select("id", "op", live.alias("live"), *texts, *(["seq"] if "seq" in changes.columns else []))
        if "seq" in rows.columns:
            last = Window.partitionBy("id").orderBy(F.desc("seq"))
            rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1")
        tokens = F.when(put, X.index_tokens(F.col("title"), F.col("content"), F.col("tags")))
        notes = rows.where("op IN ('put', 'drop')").select("id", "live", tokens.alias("tokens"))
        run = Run(batch, batch, f"{self.path}/runs/{batch}-{batch}")
        entries = self._written(run, notes.mapInArrow(_counted, _LISTS))
        before = self._newest(self._entries(runs).join(entries.select("id"), "id", "left_semi")).select("id", F.col("length").alias("old"))
        change = (F.coalesce(F.sum("length"), F.lit(0)) - F.coalesce(F.sum("old"), F.lit(0))).alias("length")
        self._commit(run, entries.join(before, "id", "left").agg((F.count("length") - F.count("old")).alias("docs"), change, F.coalesce(F.sum("terms"), F.lit(0)).alias("postings")))
        return True

    def compact(self, fan: int = 4) -> int:
        """Merge the newest runs, ``fan`` or more, that have a like size: the oldest of them up to ``fan`` times the others
        together. The number of merges. Older and larger runs stay as they are."""
        merges = 0
        while True:
            runs, numbers = self.runs(), []
            for run in runs:
                numbers.append(self.spark.read.schema(_NUMBERS).parquet(f"{run.path}/numbers").first().postings)
            at = next((i for i in range(len(runs) - fan + 1) if numbers[i] <= fan * sum(numbers[i + 1 :])), None)
            if at is None:
                return merges
            self._merge(runs[at:], oldest=at == 0)
            merges += 1

    def _merge(self, runs: list[Run], oldest: bool) -> None:
        entries = self._newest(self._entries(runs))
        if oldest:  # there is nothing before them that a tombstone could hide
            entries = entries.where(F.col("length").isNotNull())
        run = Run(runs[0].first, runs[-1].last, f"{self.path}/runs/{runs[0].first}-{runs[-1].last}")
        notes = sum(self.spark.read.schema(_NUMBERS).parquet(f"{r.path}/numbers").first().docs for r in runs)
        parts = F.lit(max(1, -(-notes // LIST)))
        written_entries = self._written(run, _listed(self._valid(runs, self._postings), entries, parts))
        postings = written_entries.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("postings"))
        self._commit(run, self._numbers(runs).crossJoin(postings))

    def vacuum(self) -> int:
        """Delete the runs that others hold; no reader may be at work on them. The number of runs deleted."""
        gone = set(self._all()) - set(self.runs())
        for run in gone:
            removed(self.spark, run.path)
        return len(gone)

    # reading

    def _valid(self, runs: list[Run], lists_of) -> DataFrame:
        """Postings of the runs whose note no later run has an entry for."""
        found = self.spark.createDataFrame([], f"{_ROWS}, run long")
        for run in runs:
            rows = _rows(lists_of(run).where(F.col("bucket") != ENTRIES), self._blocks(run))
            found = found.unionAll(rows.withColumn("run", F.lit(run.first).cast("bigint")))
        touched = self._entries(runs[1:]).groupBy("id").agg(F.max("run").alias("touched"))
        return found.join(touched, "id", "left").where("touched IS NULL OR touched <= run").select("term", "id", "length", "live", "tf")

    def _numbers(self, runs: list[Run]) -> DataFrame:
        out = self.spark.createDataFrame([], _NUMBERS)
        for run in runs:
            out = out.unionAll(self.spark.read.schema(_NUMBERS).parquet(f"{run.path}/numbers"))
        return out.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))

    @property
    def sizes(self) -> tuple[float, float]:
        """Number and mean length of all notes: the sums of the runs' signed deltas."""
        got = self._numbers(self.runs()).first()
        return float(got.docs), (got.length / got.docs if got.docs else 0.0) or 1.0

    def lookup(self, terms: list[str]) -> DataFrame:
        """(term, id, length, live, tf) of the given terms, accents folded; of each run, the terms' folders are read."""
        asked = [folded(t) for t in terms]
        return self._valid(self.runs(), lambda run: _of_terms(self._postings(run), asked, keep=True))

    def all(self) -> DataFrame:
        return self._valid(self.runs(), self._postings)


def delta_index(stream: DataFrame, path: str, checkpoint: str, fan: int = 4) -> DeltaIndex:
    """STM-06 for a stream of changes: a run for each batch, compacted as it grows."""
    from ..streaming.events import drained

    index = DeltaIndex(stream.sparkSession, path)

    def each(batch: DataFrame, batch_id: int) -> None:
        if index.apply(batch_id, batch):
            index.compact(fan)

    drained(stream, checkpoint, each)
    return index


def new_index(spark: SparkSession) -> DeltaIndex:
    return DeltaIndex(spark, scratch(spark, "delta-index"))
