"""Operator 10, sharding: best-fit-decreasing bin packing of indivisible groups into shards of a fixed capacity.

Groups are sets of equal texts. They are summed up before anything is shuffled; groups of at least a
``1/units`` part of all bytes are items of their own, smaller ones are gathered by hash into at most ``units``
bundles. So the packing sees at most ``2 * units`` items however large the corpus is, and packs them by
decreasing size, each into the bin with the tightest remaining capacity, found in a balanced tree. Groups above a
shard's share have shards of their own; for the others, the capacity is the smallest at which the bins left are enough.

With a given capacity, :func:`pack_groups` packs every group on its own, at any number of groups, into as few shards as it
can: cells of some ten thousand groups are packed side by side, and the bins that have room left are packed anew, together
with those of other cells, as long as that saves bins.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_counted
from .common import carried, read_table, written

SHARDS, UNITS = 16, 8192
#: Groups that one task packs, and the fill from which on a bin is not opened again.
CELL, FULL = 50_000, 0.98
#: Number of parts that the rows of a shard are counted in for gapless slots.
SLOT_PARTS = 1024


class CapacityTree:
    """A balanced tree (AA tree) of (remaining capacity, bin): insert, and take the smallest at or above a size."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self, keys: Iterable[tuple[int, int]] = ()):
        self._root = None
        for key in keys:
            self.insert(key)

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            left = n.left
            n.left, left.right = left.right, n
            return left
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.level == n.right.right.level:
            right = n.right
            n.right, right.left = right.left, n
            right.level += 1
            return right
        return n

    def insert(self, key: tuple[int, int]) -> None:
        def add(n):
            if n is None:
                return self._Node(key)
            if key < n.key:
                n.left = add(n.left)
            else:
                n.right = add(n.right)
            return self._split(self._skew(n))

        self._root = add(self._root)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest key whose capacity is ``size`` or more."""
        best, n = None, self._root
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        if best is not None:
            self._root = self._remove(self._root, best)
        return best

    def _remove(self, n, key):
        if n is None:
            return None
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif key > n.key:
            n.right = self._remove(n.right, key)
        elif n.left is None:
            return n.right
        elif n.right is None:
            return n.left
        else:
            heir = n.right
            while heir.left:
                heir = heir.left
            n.key = heir.key
            n.right = self._remove(n.right, heir.key)
        want = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
        if want < n.level:
            n.level = want
            if n.right and n.right.level > want:
                n.right.level = want
        n = self._skew(n)
        if n.right:
            n.right = self._skew(n.right)
            if n.right.right:
                n.right.right = self._skew(n.right.right)
        n = self._split(n)
        if n.right:
            n.right = self._split(n.right)
        return n


def pack(items: list[tuple[int, str]], capacity: int) -> dict[str, int]:
    """Best-fit-decreasing: bin of each (size, name); an item above the capacity gets a bin that it overfills."""
    tree, bins, out = CapacityTree(), 0, {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        found = tree.take(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        out[name] = found[1]
        if found[0] > size:
            tree.insert((found[0] - size, found[1]))
    return out


def _smallest(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """The packing of the smallest capacity (to a part in 10,000) at which ``shards`` bins hold all items."""
    total, largest = sum(s for s, _ in items), max((s for s, _ in items), default=0)
    low = max(-(-total // shards), largest)
    high, found = low, pack(items, low)
    while max(found.values(), default=0) >= shards:
        low, high = high + 1, high + max(1, high // 64)
        found = pack(items, high)
    while high - low > max(1, total // shards // 10_000):
        middle = (low + high) // 2
        tried = pack(items, middle)
        if max(tried.values(), default=0) < shards:
            high, found = middle, tried
        else:
            low = middle + 1
    return found


def pack_into(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Items in ``shards`` bins, as near to equal as whole items allow.

    An item above the share of what is left gets a bin of its own, and the share of the others falls. The rest is packed
    at the smallest capacity; where that is over the share by more than a part in 1,000, since few items fit together,
    its fullest bin is set aside and the items left are packed anew, so that one full bin does not leave others empty.
    """
    rest = sorted(items, key=lambda x: (-x[0], x[1]))
    total, left, out = sum(s for s, _ in rest), shards, {}
    at = 0
    while at < len(rest) and rest[at][0] * left > total:
        out[rest[at][1]] = shards - left
        total, left, at = total - rest[at][0], left - 1, at + 1
    rest = rest[at:]
    found = _smallest(rest, left) if rest else {}
    while rest:
        sums = [0] * left
        for size, name in rest:
            sums[found[name]] += size
        fullest = max(range(left), key=lambda i: (sums[i], -i))
        if left == 1 or sums[fullest] * left * 1000 <= total * 1001 + 1000 * left:
            break
        others = [x for x in rest if found[x[1]] != fullest]
        tried = _smallest(others, left - 1)
        after = [0] * (left - 1)
        for size, name in others:
            after[tried[name]] += size
        if max(after) > sums[fullest]:  # best-fit may do worse on fewer items
            break
        out |= {name: shards - left for _, name in rest if found[name] == fullest}
        rest, found, total, left = others, tried, total - sums[fullest], left - 1
    return out | {name: shards - left + i for name, i in found.items()}


def _packed(capacity: int, done: int):
    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bins = pack(list(zip(rows.bytes.tolist(), rows.unit.tolist(), strict=True)), capacity)
        return pd.DataFrame({"unit": rows.unit, "bin": [f"{done}.{rows.cell.iloc[0]}.{bins[u]}" for u in rows.unit], "bytes": rows.bytes})

    return fill


def pack_groups(groups: DataFrame, capacity: int, *, cell: int = CELL, full: float = FULL) -> DataFrame:
    """(__group, shard) for groups (__group, bytes): best-fit-decreasing into few shards of ``capacity`` bytes, numbered from 0.

    No group is divided; one above the capacity has a shard of its own. All groups are packed as one where they are no
    more than ``cell``; else in cells dealt out by hash, whose bins with room left are the items of the next round.
    """
    items, where, done = groups.select(F.col("__group").alias("unit"), "bytes"), None, 0
    while True:
        cells = max(1, -(-items.count() // cell))

        dealt = items.withColumn("cell", F.pmod(F.xxhash64("unit", F.lit(done)), F.lit(cells)))
        placed = written(dealt.groupBy("cell").applyInPandas(_packed(capacity, done), "unit string, bin string, bytes long"))
        here = placed.select("unit", "bin")
        # a unit of an earlier round is a bin; what was in it goes where the bin goes
        where = here.select(F.col("unit").alias("__group"), "bin") if where is None else written(where.withColumnRenamed("bin", "unit").join(here, "unit", "left").select("__group", F.coalesce("bin", "unit").alias("bin")))
        bins = placed.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("units"))
        left = written(bins.where(F.col("bytes") < full * capacity).select(F.col("bin").alias("unit"), "bytes"))
        before, after = (items.count(), left.count()) if cells > 1 else (0, 0)
        if cells == 1 or after < 2 or after > 0.9 * before:
            number = F.row_number().over(Window.orderBy("bin")) - 1  # as many rows as there are shards
            return where.join(where.select("bin").distinct().select("bin", number.alias("shard")), "bin").select("__group", "shard")
        items, done = left, done + 1


def _group(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def shard(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, units: int = UNITS, capacity: int | None = None, carry_text: bool = True) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus one), ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    The law is ``bytes``: the sizes of the ``shards`` shards are as near to equal as whole groups allow; a group of equal
    texts is never divided, so one that is larger than a shard's share makes its shard larger. With a ``capacity`` there
    are instead as few shards as best-fit-decreasing needs of that many bytes each. Null texts are a group with the empty
    ones. Slots follow hashed parts of the ids; rows that repeat an id get slots in any order. Other columns are
    carried; ``size``, ``shard`` and ``slot`` of the input are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = [c for c in carried(docs, ["size", "shard", "slot"]) if carry_text or c != text]
    rows = docs.select(*[f"`{c}`" for c in keep], (F.octet_length(said) + 1).cast("bigint").alias("size"), _group(said).alias("__group"))
    if not carry_text:
        rows = written(rows)  # narrow; the texts are read once
    groups = written(rows.groupBy("__group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    parts = SLOT_PARTS
    if capacity is not None:
        sizes = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        placed = written(pack_groups(groups, capacity).join(groups.select("__group", "n"), "__group"))
        count = placed.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]
        parts = max(1, min(parts, (1 << 20) // int(count)))
        out = join_counted(rows, placed, ["__group"], sizes.rows)
    else:
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        floor = max(1, -(-total // units))
        bundle = F.concat(F.lit("~"), F.pmod(F.xxhash64("__group"), F.lit(units)).cast("string"))
        summed = groups.withColumn("unit", F.when(F.col("bytes") >= floor, F.col("__group")).otherwise(bundle)).groupBy("unit").agg(F.sum("bytes").alias("bytes"))
        placed = pack_into([(r.bytes, r.unit) for r in summed.collect()], shards)  # 2 * units rows at most
        table = spark.createDataFrame(list(placed.items()), T.StructType([T.StructField("unit", T.StringType()), T.StructField("shard", T.IntegerType())]))
        own = F.broadcast(table.where("unit not like '~%'").select(F.col("unit").alias("__group"), F.col("shard").alias("__own")))
        shared = F.broadcast(table.where("unit like '~%'").select(F.col("unit").alias("__unit"), F.col("shard").alias("__shared")))
        out = rows.join(own, "__group", "left").withColumn("__unit", bundle).join(shared, "__unit", "left")
        out = out.withColumn("shard", F.coalesce("__own", "__shared"))
    out = out.withColumn("__part", F.pmod(F.xxhash64(F.col(doc_id).cast("string"), "__group"), F.lit(parts)).cast("int"))
    return _slots(out, ["shard", "__part"], [F.col(doc_id), F.col("__group")]).select(*[f"`{c}`" for c in keep], "size", "shard", "slot")


def _slots(rows: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """Gapless numbers in each value of the first key: a number within the part after the rows of the parts before."""
    counts = rows.groupBy(*part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(part[0]).orderBy(part[1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))  # 2**20 rows at most
    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return numbered.join(starts, part).withColumn("slot", (F.col("__before") + F.col("__nth") - 1).cast("bigint"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(docs, carry_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
