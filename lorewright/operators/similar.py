"""Duplicates and similarity (SIM-*, VEC-*): exact groups, shingle Jaccard by equal parts of sets, cosine by projection bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..store import written
from .cells import cosine_pairs  # noqa: F401  SIM-01, JOI-13 are part of this module's operators
from .joins import among, components, join_counted
from .setparts import may_be_similar, part_keys

NEAR, MIN_CONTENT, MIN_RATIO, MAX_NEAR_GROUP = 0.85, 80, 0.5, 12
COSINE = 0.92
#: Titles with one word that meet in a task at a time.
TITLES = 2048


def _star(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """Links of each member to the smallest id of its key: as many as there are members, never all pairs."""
    rows = written(rows)  # what the key is made from is read once
    least = rows.groupBy(key).agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return join_counted(rows, least, [key], rows.count()).where("id <> b").select(F.col("id").alias("a"), "b", F.lit(reason).alias("reason"), F.lit(1.0).alias("similarity"))


def same_title(notes: DataFrame) -> DataFrame:
    """SIM-05: links of notes with one normalised title."""
    return _star(notes.select("id", X.normal_form(F.col("title")).alias("k")).where("k <> ''"), "k", "identical-title")


def same_content(notes: DataFrame) -> DataFrame:
    """SIM-05: links of notes with one normalised content of more than 30 characters."""
    rows = notes.select("id", X.normal_form(F.col("content")).alias("c")).where("length(c) > 30").select("id", F.md5(F.col("c").cast("binary")).alias("k"))
    return _star(rows, "k", "identical-content")


@dataclass(frozen=True)
class _Classes:
    """Notes as classes of one set of shingles and one length: ``rows`` (id, len, s) has all notes, ``copies`` (a, b,
    similarity) links the other notes of a class to the first, which alone are compared; of these ``keys`` (id, n, t, own) has
    the keys of parts that more than one shares and ``bits`` (id, n, bits) some bits of each set, see :mod:`.setparts`."""

    rows: DataFrame
    copies: DataFrame
    keys: DataFrame
    bits: DataFrame
    threshold: float

    @staticmethod
    def of(notes: DataFrame, threshold: float) -> _Classes:
        text = notes.where(F.length("content") >= MIN_CONTENT)
        hashed = F.array_sort(F.transform(X.shingles(F.col("title"), F.col("content")), lambda t: F.xxhash64(t)))
        every = written(text.select("id", F.length("content").alias("len"), hashed.alias("s")).withColumn("k", F.xxhash64("s", "len")))
        first = written(every.groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
        of_more = first.where("copies > 1").select("k", F.col("id").alias("a"), "copies")
        copies = written(join_counted(every.select("id", "k"), of_more, ["k"], every.count(), "copies").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
        signed = written(part_keys(every, threshold).join(copies.select(F.col("b").alias("id")), "id", "left_anti"))
        each = signed.select("id", "n", F.explode("own").alias("t"), F.lit(True).alias("own")).unionAll(signed.select("id", "n", F.explode("next").alias("t"), F.lit(False).alias("own")))
        held = written(each.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"))
        keys = join_counted(among(each, "t", held), held.withColumn("n_rows", F.col("c")), ["t"], signed.agg(F.coalesce(F.sum(F.size("own") + F.size("next")), F.lit(0))).first()[0], "n_rows")
        return _Classes(every.select("id", "len", "s"), copies, written(keys.select("id", "n", "t", "own")), signed.select("id", "n", "bits"), threshold)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of those pairs (a, b) of classes that are similar."""
        x, y = (self.bits.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
        pairs = pairs.join(x, "a").join(y, "b").where(may_be_similar(F.col("na"), F.col("bits_a"), F.col("nb"), F.col("bits_b"), self.threshold))
        pairs = written(pairs.select("a", "b"))
        rows = among(self.rows, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))
        one, other = rows.select(F.col("id").alias("a"), F.col("len").alias("la"), F.col("s").alias("sa")), rows.select(F.col("id").alias("b"), F.col("len").alias("lb"), F.col("s").alias("sb"))
        out = pairs.join(one, "a").join(other, "b").where(F.least("la", "lb") / F.greatest("la", "lb") >= MIN_RATIO)
        return out.select("a", "b", N.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") > self.threshold)

    def pairs(self, some: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) that meet under a key and whose sizes allow it; ``some`` (id): at least one of them is of these."""
        mine = self.keys if some is None else self.keys.join(some, "id", "left_semi")
        a, b = mine.select(F.col("id").alias("x"), F.col("n").alias("na"), "t", F.col("own").alias("oa")), self.keys.select(F.col("id").alias("y"), F.col("n").alias("nb"), "t", F.col("own").alias("ob"))
        once = F.col("x") < F.col("y") if some is None else F.col("x") != F.col("y")
        met = a.join(b, "t").where(once & (F.col("oa") | F.col("ob")) & (F.least("na", "nb") > self.threshold * F.greatest("na", "nb")))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def stars(self) -> DataFrame:
        """Pairs of each class with the first and the last class under each of its keys: two for each key at most."""
        ends = written(self.keys.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("c > 1"))
        met = join_counted(self.keys.select("id", "t"), ends, ["t"], self.keys.count(), "c")
        each = met.select("id", F.explode(F.array("lo", "hi")).alias("y")).where("id <> y")
        return each.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct()


def _held(each: DataFrame, total: int) -> DataFrame:
    """(id, n, held): of rows (id, n, t) those ``t`` that more than one row has, the rarest first, with their counts."""
    df = written(each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"))
    found = join_counted(each, df.withColumn("rows", F.col("df")), ["t"], total, "rows")
    return found.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("held"))


def near_content(notes: DataFrame, threshold: float = NEAR, dismissed: DataFrame | None = None) -> DataFrame:
    """SIM-05: links (a, b, reason, similarity) of notes whose word-pair sets have a Jaccard similarity above ``threshold``.

    Notes with the same set and the same length are one class: each is linked to the smallest id of its class, and classes
    are compared by that one; so copies are not expanded into all pairs, and no link between different texts is lost. Each
    class stands under hashes of parts of its set, so many that any similar one has a part that is the same; pairs that meet
    there and whose sizes allow it are compared whole. Shingles are 64-bit hashes; they are written once and shuffled only
    for classes that meet another.
    """
    classes = _Classes.of(notes, threshold)
    return without(_near(classes.verified(classes.pairs()), classes), dismissed)


def _near(links: DataFrame, classes: _Classes) -> DataFrame:
    return links.unionByName(classes.copies).select("a", "b", F.lit("near-identical").alias("reason"), "similarity")


def near_in_small_chains(notes: DataFrame, threshold: float = NEAR, dismissed: DataFrame | None = None, largest: int = MAX_NEAR_GROUP) -> DataFrame:
    """SIM-06: those links of :func:`near_content` that chain ``largest`` notes at most.

    What is in a longer chain by its links to the first and the last class of each key alone is settled: its links
    among each other can add nothing that stays. So a family of n near copies costs some n comparisons, and only classes
    that are not settled are compared with all that they meet.
    """
    classes = _Classes.of(notes, threshold)
    stars = written(without(_near(classes.verified(classes.stars()), classes), dismissed))
    chains = written(components(stars.select("a", "b")))
    settled = chains.join(chains.groupBy("root").count().where(F.col("count") > largest), "root", "left_semi").select(F.col("node").alias("id"))
    others = written(classes.rows.select("id").join(settled, "id", "left_anti"))
    links = written(without(_near(classes.verified(classes.pairs(others)), classes), dismissed))
    chains = components(links.unionByName(stars).select("a", "b"))
    sizes = chains.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= largest)
    return links.join(chains.join(sizes, "root", "left_semi").select(F.col("node").alias("a")), "a", "left_semi")


def without(pairs: DataFrame, dismissed: DataFrame | None) -> DataFrame:
    """SIM-07: pairs (a, b) that the user set aside never link; the order of the two ids does not matter."""
    if dismissed is None:
        return pairs
    set_aside = dismissed.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return pairs.join(set_aside, (F.least(pairs.a, pairs.b) == F.col("x")) & (F.greatest(pairs.a, pairs.b) == F.col("y")), "left_anti")


def duplicate_groups(notes: DataFrame, threshold: float = NEAR, dismissed: DataFrame | None = None, largest_near: int = MAX_NEAR_GROUP) -> DataFrame:
    """SIM-06: (key, id, reason, similarity, size, keep_id): groups over all three kinds of links.

    Near links that alone would chain more than ``largest_near`` notes are left out. A group has its strongest reason and
    its weakest similarity; the note to keep is the longest, then the newest, then the first by id (SRT-05).
    """
    near = near_in_small_chains(notes, threshold, dismissed, largest_near)
    links = written(without(same_title(notes), dismissed).unionByName(without(same_content(notes), dismissed)).unionByName(near))
    member = written(components(links.select("a", "b")))
    rank = F.when(F.col("reason") == "identical-title", 0).when(F.col("reason") == "identical-content", 1).otherwise(2)
    about = links.join(member.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.min_by("reason", rank).alias("reason"), F.min("similarity").alias("similarity"))
    rows = member.join(notes.select(F.col("id").alias("node"), F.length("content").alias("len"), "updated_at"), "node")
    best = rows.groupBy("root").agg(F.min(F.struct(-F.col("len"), -F.col("updated_at"), F.col("node").alias("id"))).alias("k"), F.count("*").alias("size"))
    return rows.join(best, "root").join(about, "root").select(F.col("root").alias("key"), F.col("node").alias("id"), "reason", "similarity", "size", F.col("k.id").alias("keep_id"))


def redundant(groups: DataFrame) -> DataFrame:
    """AGG-22."""
    return groups.select("key", "size").distinct().agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("redundant"))


def _titles(notes: DataFrame) -> DataFrame:
    """(id, w, tags, rep): notes with words in their title; ``rep`` is the first note with the same words and the same tags."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), r"[^A-Za-z0-9_]+"), lambda w: F.length(w) > 2)))
    every = written(notes.select("id", words.alias("w"), F.array_sort(F.array_distinct("tags")).alias("tags")).where((F.size("w") > 0) & F.col("tags").isNotNull()))
    first = written(every.groupBy("w", "tags").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    return written(join_counted(every, first, ["w", "tags"], every.count()))


def _title_links(titles: DataFrame, overlap: float, tag_jaccard: float) -> DataFrame:
    """(a, b, overlap) of the classes of ``titles`` that agree.

    The smaller set of a pair must share one of its rarest words with the other, so only those few meet the inverted index
    of all words, whose frequent words are dealt into parts. A pair is judged where it meets, so only pairs that agree go on.
    """
    rows = titles.where("id = rep").select("id", F.size("w").alias("n"), "w", "tags")
    held = _held(rows.select("id", "n", F.explode("w").alias("t")), rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    held = written(held.join(rows.select("id", "w", "tags"), "id"))
    left = N.signature_length(F.col("n"), overlap, None) - (F.col("n") - F.size("held"))
    rare = F.when(left > 0, F.slice("held", F.lit(1), F.greatest(left, F.lit(1))))
    parts = F.ceil(F.col("v.df") / TITLES).cast("int")
    x = held.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("w").alias("wx"), F.col("tags").alias("tx"), F.explode(rare).alias("v"))
    x = x.select("x", "nx", "wx", "tx", F.col("v.t").alias("t"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    y = held.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("w").alias("wy"), F.col("tags").alias("ty"), F.explode("held").alias("v"))
    y = y.select("y", "ny", "wy", "ty", F.col("v.t").alias("t"), F.pmod(F.xxhash64("y"), parts).cast("int").alias("part"))
    agree = (F.size("tx") == 0) | (F.size("ty") == 0) | (N.jaccard(F.col("tx"), F.col("ty")) >= tag_jaccard)
    met = x.join(y, ["t", "part"]).where("nx < ny OR (nx = ny AND x < y)").where(agree)
    near = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), N.overlap(F.col("wx"), F.col("wy")).alias("overlap"))
    return near.where(F.col("overlap") >= overlap).distinct()


def title_tag_pairs(notes: DataFrame, overlap: float = 0.85, tag_jaccard: float = 0.5) -> DataFrame:
    """SIM-02, JOI-12: pairs (a, b, overlap) whose title words overlap and whose tags agree (or are missing on one side).

    Notes with the same words and the same tags are one class; only classes are compared, and their members are put in last.
    """
    titles = _titles(notes)
    member = titles.select("rep", "id")
    one, other = member.select(F.col("rep").alias("a"), F.col("id").alias("x")), member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    inside = one.join(other, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("overlap"))
    across = _title_links(titles, overlap, tag_jaccard).join(one, "a").join(other, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "overlap")
    return across.unionByName(inside).select(F.col("x").alias("a"), F.col("y").alias("b"), "overlap")


def centroids(chunks: DataFrame) -> DataFrame:
    """ARR-02: unit mean vector of each note's chunks within its first model (by name)."""
    first = chunks.groupBy("memory_id").agg(F.min("model").alias("model"))
    mine = chunks.join(first, ["memory_id", "model"]).groupBy("memory_id", "model").agg(F.collect_list("embedding").alias("v"))  # a note has few chunks
    zero = F.transform(F.get("v", 0), lambda x: F.lit(0.0))
    total = F.aggregate("v", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    ordered = mine.select("memory_id", "model", F.transform(total, lambda x: x / F.size("v")).alias("c"))
    return ordered.withColumn("norm", N.norm(F.col("c"))).where("norm > 0").select(F.col("memory_id").alias("id"), "model", F.transform("c", lambda x: x / F.col("norm")).alias("c"))


def keep_choice(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """SIM-03: (keep_id, duplicate_id): the newer and longer note of a pair; at a tie the first."""
    weight = notes.select("id", (F.col("updated_at") + 1000 * F.length("content")).alias("w"))
    rows = pairs.join(weight.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(weight.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return rows.select(F.when(F.col("wa") >= F.col("wb"), F.col("a")).otherwise(F.col("b")).alias("keep_id"), F.when(F.col("wa") >= F.col("wb"), F.col("b")).otherwise(F.col("a")).alias("duplicate_id"))


def apply_consolidation(candidates: DataFrame) -> DataFrame:
    """SIM-04: candidates (keep_id, duplicate_id, n) in the order of n; one counts only while both its notes are live.

    A candidate depends on earlier ones that touch its notes, so each connected component is folded on its own.
    """
    pairs = candidates.select(F.col("keep_id").alias("a"), F.col("duplicate_id").alias("b"))
    root = components(pairs).select(F.col("node").alias("keep_id"), "root")
    rows = candidates.join(root, "keep_id").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", "keep_id", "duplicate_id"))).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("gone"), F.array().cast("array<struct<keep_id:string,duplicate_id:string>>").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        live = ~F.array_contains(acc["gone"], x["keep_id"]) & ~F.array_contains(acc["gone"], x["duplicate_id"])
        return F.struct(
            F.when(live, F.concat(acc["gone"], F.array(x["duplicate_id"]))).otherwise(acc["gone"]).alias("gone"),
            F.when(live, F.concat(acc["done"], F.array(F.struct(x["keep_id"].alias("keep_id"), x["duplicate_id"].alias("duplicate_id"))))).otherwise(acc["done"]).alias("done"),
        )

    return rows.select(F.explode(F.aggregate("rows", start, add)["done"]).alias("d")).select("d.keep_id", "d.duplicate_id")


def nearest(chunks: DataFrame, vector: list[float], model: str, threshold: float = COSINE) -> DataFrame:
    """VEC-01: the note nearest to a vector, if it is near enough; ties by id."""
    near = chunks.where(F.col("model") == model).select(F.col("memory_id").alias("id"), N.cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in vector])).alias("cosine"))
    return near.orderBy(F.desc("cosine"), "id").limit(1).where(F.col("cosine") >= threshold)


def hashed_vector(words: Column, size: int = 16) -> Column:
    """VEC-02: a deterministic stand-in for an embedding model: each word adds to two of ``size`` places."""
    places = F.flatten(F.transform(words, lambda w: F.array(F.length(w) % size, (F.ascii(w) + F.ascii(F.substring(w, -1, 1))) % size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


def batches(rows: DataFrame, items: int = 100, characters: int = 700_000) -> DataFrame:
    """VEC-03: rows (part, n, text) with a batch number such that a batch of a part has bounded items and characters.

    Batches are cut where the running count or the running characters pass a multiple of the bound, so a batch can hold
    one text more than its characters allow, and a very long text is alone with what follows it.

    Rows that have the text's ``length`` in its place do as well. Rows are dealt out by ranges of (part, n); running numbers
    are taken within a range and carried on by the sums of the ranges before it, so a part is never one task.
    """
    if "length" not in rows.columns:
        return batches(rows.withColumn("length", F.length("text")), items, characters).drop("length")
    ranged = written(rows.repartitionByRange("part", "n").sortWithinPartitions("part", "n").withColumn("range", F.spark_partition_id()))
    by_range = Window.partitionBy("part").orderBy("range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, sums: DataFrame) -> DataFrame:
        return rows.join(sums, rows["part"].eqNullSafe(sums["p"]) & (rows["range"] == sums["r"])).drop("p", "r")

    sums = ranged.groupBy("part", "range").agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("characters"))
    sums = sums.select(F.col("part").alias("p"), F.col("range").alias("r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "characters")])
    w = Window.partitionBy("part", "range").orderBy("n")
    so_far = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length") + F.col("characters_before")
    cut = F.struct(F.floor((F.row_number().over(w) - 1 + F.col("rows_before")) / items).alias("i"), F.floor(so_far / characters).alias("c"))
    each = written(carried(ranged, sums).withColumn("cut", cut).drop("rows_before", "characters_before"))
    # a cut that goes on from the range before is the batch of that range's last row
    cuts = each.groupBy("part", "range").agg(F.count_distinct("cut").alias("cuts"), F.min("cut").alias("first"), F.max("cut").alias("last"))
    new = F.col("cuts") - F.when(F.col("first") == F.lag("last").over(by_range), 1).otherwise(0)
    cuts = cuts.select(F.col("part").alias("p"), F.col("range").alias("r"), new.alias("new"), (F.col("cuts") - new).alias("on"))
    start = F.coalesce(F.sum("new").over(Window.partitionBy("p").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("on")
    rank = F.dense_rank().over(Window.partitionBy("part", "range").orderBy("cut"))
    return carried(each, cuts.select("p", "r", start.alias("start"))).withColumn("batch", (rank + F.col("start")).cast("int")).drop("cut", "range", "start")


def to_embed(chunks: DataFrame, model: str) -> DataFrame:
    """SRC-07, VEC-04: chunks without a vector of the wanted model."""
    return chunks.where(F.col("embedding").isNull() | F.col("model").isNull() | ~F.col("model").eqNullSafe(model))
