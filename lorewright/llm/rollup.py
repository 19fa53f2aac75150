"""Operator 9, token counts: delta-maintained rollups by source, language and tokenizer version.

A batch of changes is turned into signed deltas (documents, tokens, bytes) and summed by key before anything is stored.
Each try of a batch has a folder of its own below the batch's id, written in one Spark commit; of a batch's finished tries
the first by name counts alone. So a batch that is there is not applied again, one that was cut off leaves nothing, and two
writers of one batch at a time do no harm. Totals are the sums over all committed batches, so the order of batches does not
matter, and a reader sees whole batches only.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_counted
from .common import chunks, map_text, read_table, scratch, text_bytes, written
from .words import scan

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "bytes")
#: Folder of the public vocabularies; a parameter of whatever counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the usual word pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_STORED = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"


class Rollup:
    """Additive totals in a folder of any store that Spark writes to.

    ``batches/<id>/<try>`` holds the summed deltas of a try of a batch, ``bases/<number>`` the sums of the batches whose ids
    it lists. A folder counts once Spark has put its ``_SUCCESS`` there; the newest base counts alone. The driver lists the
    folders since the last compaction, never the ids before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, path: str) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(there)) if fs.exists(there) else []

    def _finished(self, path: str) -> list[str]:
        """Names of the finished folders below a path."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [n for n in self._names(path) if fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]

    def _batches(self) -> dict[str, str]:
        """Folder of the try that counts of each committed batch whose folder is still there."""
        tries = {n: self._finished(f"{self.path}/batches/{n}") for n in self._names(f"{self.path}/batches")}
        return {n: f"{self.path}/batches/{n}/{done[0]}" for n, done in tries.items() if done}

    def _base(self) -> DataFrame | None:
        found = self._finished(f"{self.path}/bases")
        return self.spark.read.schema(f"{_STORED}, absorbed string").parquet(f"{self.path}/bases/{found[-1]}") if found else None

    def _absorbed(self, ids: list[str]) -> set[str]:
        """Those of the ids that the newest base holds."""
        base = self._base()
        return set() if base is None or not ids else {r.absorbed for r in base.where(F.col("absorbed").isin(ids)).select("absorbed").distinct().collect()}

    def committed(self, batch_id: str) -> bool:
        return bool(self._finished(f"{self.path}/batches/{batch_id}")) or batch_id in self._absorbed([batch_id])

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it is there already. See :func:`deltas` for the columns.

        A batch must say the same at every try.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch_id):
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch_id!r}")
        if self.committed(batch_id):
            return False
        summed = deltas(changes).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        summed.write.parquet(f"{self.path}/batches/{batch_id}/{uuid.uuid4().hex}")
        return True

    def _summed(self) -> tuple[DataFrame, set[str]]:
        """Sums of all committed batches, and the ids of those that the newest base does not hold."""
        batches, base = self._batches(), self._base()
        fresh = set(batches) - self._absorbed(list(batches))
        rows = self.spark.createDataFrame([], _STORED)
        if base is not None:
            rows = base.where("absorbed is null").drop("absorbed")
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(_STORED).parquet(*[batches[n] for n in sorted(fresh)]))
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS]), fresh

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose sums are all zero are left out. No batch: no rows."""
        return self._summed()[0].where("docs != 0 or tokens != 0 or bytes != 0")

    def compact(self) -> None:
        """Write a new base that holds all committed batches and their ids, in one commit; later commits are added to it.

        The folders of the batches may be deleted afterwards. Their ids stay known, so none is applied again. One
        compaction runs at a time.
        """
        rows, fresh = self._summed()
        names = self.spark.createDataFrame([(n,) for n in sorted(fresh)], "absorbed string")
        base = self._base()
        if base is not None:
            names = names.unionByName(base.where("absorbed is not null").select("absorbed"))
        last = self._names(f"{self.path}/bases")
        rows.unionByName(names, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/bases/{int(last[-1]) + 1 if last else 0:012d}")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed rows from ``op`` (insert, delete, revise), keys, ``tokens``, ``bytes`` and, for a revision, ``old_tokens``, ``old_bytes``.

    An insert adds a document, a delete takes it away, a revision adds the difference of the counts. Null keys are keys;
    null counts are zero. Any other ``op`` adds nothing. Repeated rows count as often as they come. Other columns are
    ignored.
    """
    had = set(changes.columns)
    sign = F.coalesce(F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1), F.lit(0))
    revised = F.col("op") == "revise"

    def count(name: str):
        now = F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))
        old = F.coalesce(F.col(f"old_{name}").cast("bigint"), F.lit(0).cast("bigint")) if f"old_{name}" in had else F.lit(0).cast("bigint")
        return F.when(revised, now - old).otherwise(sign * now).alias(name)

    return changes.select(*[F.col(k).cast("string").alias(k) for k in KEYS], sign.cast("bigint").alias("docs"), count("tokens"), count("bytes"))


def count_words(docs: DataFrame, *, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``: runs of letters, digits and non-ASCII characters; null: 0."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            data, offs = text_bytes(texts)
            n = [np.bincount(scan(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).row, minlength=b - a) for a, b in chunks(offs)]
            return [pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("n_tokens", T.LongType())]), carry_text)


#: Characters of a longer text that are encoded at once.
PIECE_CHARS = 1 << 18
#: A word ends before a space that another one follows, so the pattern never goes over this place.
_BREAK = re.compile(r"[A-Za-z](?= [A-Za-z])")


def _pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text that are encoded as the whole is; about ``size`` characters where it has words."""
    start = 0
    while len(text) - start > size:
        found = _BREAK.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def count_bpe(docs: DataFrame, *, vocabulary: str = VOCABULARY, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` of a byte-level BPE vocabulary, over whole texts; null: 0. The file must be on every executor."""

    def make():
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([sum(len(encoding.encode_ordinary(part)) for part in _pieces(t)) if t else 0 for t in texts.to_pylist()], pa.int64())]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("n_tokens", T.LongType())]), carry_text)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents, two of them tried twice: loads under two tokenizers, then, for the second one, exact
    counts for the estimates, and deletes of the documents whose text another one with a smaller id has."""
    said = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").alias("t"), F.octet_length(said).cast("bigint").alias("bytes"), F.xxhash64(said).alias("h"), F.xxhash64(F.lit("check"), said).alias("g"))
    counts = written(count_bpe(count_words(docs, text="t").withColumnRenamed("n_tokens", "words"), text="t", carry_text=False).select("doc_id", "source", "lang", "bytes", "h", "g", "words", "n_tokens"))
    firsts = counts.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = join_counted(counts, firsts, ["h", "g"], counts.count()).where("doc_id > first")
    estimate = F.ceil(F.col("bytes") / 4)
    rollup = Rollup(spark, scratch(spark))
    words = counts.select(F.lit("insert").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens"), "bytes")
    guess = counts.select(F.lit("insert").alias("op"), "source", "lang", F.lit("bpe50k-1").alias("tokenizer"), estimate.alias("tokens"), "bytes")
    exact = counts.select(F.lit("revise").alias("op"), "source", "lang", F.lit("bpe50k-1").alias("tokenizer"), F.col("n_tokens").alias("tokens"), "bytes", estimate.alias("old_tokens"), F.col("bytes").alias("old_bytes"))
    gone = copies.select(F.lit("delete").alias("op"), "source", "lang", F.lit("bpe50k-1").alias("tokenizer"), F.col("n_tokens").alias("tokens"), "bytes")
    for batch_id, changes in (("load-words", words), ("load-bpe", guess), ("load-bpe", guess), ("exact-bpe", exact), ("drop-copies", gone), ("load-words", words)):
        rollup.apply(batch_id, changes)
    return rollup.totals()
