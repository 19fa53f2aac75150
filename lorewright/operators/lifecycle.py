"""Changes of notes (DML-*): each is a snapshot in, a snapshot out; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X

TYPES = ("semantic", "episodic", "procedural", "reference")


def prepared(rows: DataFrame, now_ms: int) -> DataFrame:
    """DML-01: defaults and limits of a new note: title 200, content 200 000, tags cleaned, confidence 0 to 1, a type."""
    kind = C.note_type(F.col("title"), F.col("content"), F.col("tags"), F.lit(None).cast("string"))["type"]
    return rows.withColumns(
        {
            "title": X.sanitize_title(F.coalesce("title", F.lit(""))),
            "content": X.sanitize_text(F.coalesce("content", F.lit("")), 200_000),
            "tags": X.sanitize_tags(F.coalesce("tags", F.array().cast("array<string>"))),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))),
            "type": F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise(kind),
            "created_at": F.coalesce("created_at", F.lit(now_ms)),
            "updated_at": F.coalesce("updated_at", F.lit(now_ms)),
        }
    )


def insert(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-01: the new snapshot, and the rows turned away because their id is there or comes twice (the first by content stays)."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("title", "content")))
    fresh = first.where("__n = 1").drop("__n").join(table.select("id"), "id", "left_anti")
    turned = first.join(fresh.select("id", F.lit(1).alias("__n"), F.lit(True).alias("__in")), ["id", "__n"], "left").where("__in IS NULL").drop("__n", "__in")
    return table.unionByName(fresh, allowMissingColumns=True), turned


def merge(table: DataFrame, patches: DataFrame, columns: list[str], now_ms: int | None = None) -> DataFrame:
    """DML-02, DML-03: rows of ``patches`` (one per id) by id: fields that are not null replace, unknown ids are added."""
    other = [c for c in table.columns if c != "id"]
    p = patches.select("id", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    out = table.withColumn("__had", F.lit(True)).join(p, "id", "full_outer")
    pick = {c: F.coalesce(f"__{c}", c) if c in columns else F.col(c) for c in other}
    if now_ms is not None and "updated_at" in other:
        pick["updated_at"] = F.when(F.col("__hit"), F.lit(now_ms)).otherwise(F.col("updated_at"))
        if "created_at" in other:
            pick["created_at"] = F.when(F.col("__had").isNull(), F.lit(now_ms)).otherwise(F.col("created_at"))
    return out.select("id", *[pick[c].alias(c) for c in other])


def versions(table: DataFrame, patches: DataFrame, now_ms: int) -> DataFrame:
    """DML-03: what goes to the history: the text before a patch that changes title or content."""
    p = patches.select("id", F.col("title").alias("t"), F.col("content").alias("c"))
    changed = (F.col("t").isNotNull() & (F.col("t") != F.col("title"))) | (F.col("c").isNotNull() & (F.col("c") != F.col("content")))
    return table.join(p, "id").where(changed).select(F.col("id").alias("memory_id"), "title", "content", F.lit(now_ms).alias("created_at"))


def stale_chunks(chunks: DataFrame, table: DataFrame, patches: DataFrame) -> DataFrame:
    """DML-03, DML-08: chunks that stay: those of notes whose content a patch does not change."""
    p = patches.where(F.col("content").isNotNull()).select("id", F.col("content").alias("c"))
    changed = table.join(p, "id").where(F.col("c") != F.col("content")).select(F.col("id").alias("memory_id"))
    return chunks.join(changed, "memory_id", "left_anti")


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """DML-08: all chunks of the notes in ``fresh`` give way to the new ones."""
    return chunks.join(fresh.select("memory_id").distinct(), "memory_id", "left_anti").unionByName(fresh)


def set_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """DML-19: vectors (memory_id, seq, embedding, model) by chunk."""
    v = vectors.select("memory_id", "seq", F.col("embedding").alias("__e"), F.col("model").alias("__m"))
    out = chunks.join(v, ["memory_id", "seq"], "left")
    return out.select("memory_id", "seq", F.coalesce("__e", "embedding").alias("embedding"), F.when(F.col("__e").isNotNull(), F.col("__m")).otherwise(F.col("model")).alias("model"))


def trash(table: DataFrame, ids: DataFrame, at_ms: int | None) -> DataFrame:
    """DML-04: soft delete (``at_ms``) or restore (None) of the ids given."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return table.join(hit, "id", "left").withColumn("deleted_at", F.when(F.col("__hit"), F.lit(at_ms).cast("long")).otherwise(F.col("deleted_at"))).select(*table.columns)


def purge(table: DataFrame, dependents: list[tuple[DataFrame, str]], ids: DataFrame) -> list[DataFrame]:
    """DML-04: the notes and what hangs on them, without the ids given."""
    gone = ids.select("id").distinct()
    return [table.join(gone, "id", "left_anti")] + [d.join(gone.withColumnRenamed("id", key), key, "left_anti") for d, key in dependents]


def forget(table: DataFrame, orders: DataFrame, now_ms: int) -> DataFrame:
    """DML-05, DML-12, DML-16: orders (id, mode, by, at) expire, supersede, delete, or close a window at ``at`` if that is later than its start."""
    o = orders.select("id", F.col("mode").alias("__mode"), F.col("by").alias("__by"), F.col("at").alias("__at"))
    out = table.join(o, "id", "left")
    start = F.coalesce("valid_from", "created_at")
    end = F.when(F.col("__mode") == "expire", F.lit(now_ms)).when((F.col("__mode") == "window") & (F.col("__at") > start), F.col("__at")).otherwise(F.col("valid_to"))
    return out.withColumns(
        {
            "valid_to": end,
            "superseded_by": F.when(F.col("__mode") == "supersede", F.col("__by")).otherwise(F.col("superseded_by")),
            "deleted_at": F.when(F.col("__mode") == "delete", F.lit(now_ms)).otherwise(F.col("deleted_at")),
        }
    ).select(*table.columns)


def record_access(table: DataFrame, log: DataFrame) -> DataFrame:
    """DML-06: accesses (id, call, at): a call counts once for each id it touches."""
    seen = log.select("id", "call", "at").groupBy("id", "call").agg(F.max("at").alias("at")).groupBy("id").agg(F.count("*").alias("__n"), F.max("at").alias("__at"))
    out = table.join(seen, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "last_access_at": F.coalesce("__at", "last_access_at")}).select(*table.columns)


def reinforce(table: DataFrame, log: DataFrame) -> DataFrame:
    """DML-07: utility changes (id, n, delta) in the order of n, clamped to 0 to 1 after each; the order matters, so it is a fold by note."""
    steps = log.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "delta"))).alias("__steps"))
    out = table.join(steps, "id", "left")
    folded = F.aggregate("__steps", F.col("utility"), lambda u, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), u + s["delta"])))
    return out.withColumn("utility", F.coalesce(folded, F.col("utility"))).select(*table.columns)


def restore_version(table: DataFrame, history: DataFrame, wanted: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """DML-09: notes set to an old version (wanted: id, version_id); the text they had becomes a version first."""
    old = history.join(wanted, (history.memory_id == wanted.id) & (history.version_id == wanted.version_id)).select(F.col("memory_id").alias("id"), history.title, history.content)
    kept = versions(table, old, now_ms)
    return merge(table, old, ["title", "content"], now_ms), kept


def bulk(table: DataFrame, ids: DataFrame) -> DataFrame:
    """DML-10: how many distinct ids were named, how many notes there are of them, and how many were not found."""
    named = ids.select("id").distinct()
    hit = named.join(table.select("id", F.lit(1).alias("hit")), "id", "left")
    return hit.agg(F.count("*").alias("named"), F.count("hit").alias("changed"), F.count_if(F.col("hit").isNull()).alias("not_found"))


def reclassify(table: DataFrame) -> DataFrame:
    """DML-11: (type, before, after): the histogram of types as they are and as the rules would set them."""
    kind = C.note_type(F.col("title"), F.col("content"), F.col("tags"), F.lit(None).cast("string"))["type"]
    both = table.select(F.col("type").alias("type"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(table.select(kind, F.lit(0), F.lit(1)))
    return both.groupBy("type").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def repair_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """DML-13, JOI-14: parts (file, id, n) against parts (file, n, content), matched by position within a file: update, drop or insert."""
    a = old.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("n", "id"))).select("file", "pos", "id")
    b = new.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("n"))).select("file", "pos", "content")
    out = a.join(b, ["file", "pos"], "full_outer")
    return out.select("file", "pos", F.when(F.col("id").isNull(), "insert").when(F.col("content").isNull(), "drop").otherwise("update").alias("action"), "id", "content")


def settings(table: DataFrame, changes: DataFrame) -> DataFrame:
    """DML-17: key and value changes; a null value takes the key away."""
    c = changes.select("key", F.col("value").alias("__v"), F.lit(True).alias("__hit"))
    out = table.join(c, "key", "full_outer").select("key", F.when(F.col("__hit"), F.col("__v")).otherwise(F.col("value")).alias("value"))
    return out.where("value IS NOT NULL")


def accepted_pairs(table: DataFrame, new: DataFrame, most: int = 2000) -> DataFrame:
    """DML-21: pair keys (key, at) that stay accepted: each once, the newest ``most``."""
    one = table.unionByName(new).groupBy("key").agg(F.max("at").alias("at"))
    return one.orderBy(F.desc("at"), "key").limit(most)


def indexed_chunks(notes: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """DML-14, DML-18, DML-20: (memory_id, seq, text): title and tags first, then the content in chunks."""
    header = F.array(F.concat_ws("\n", "title", F.array_join("tags", " ")))
    return notes.select(F.col("id").alias("memory_id"), F.posexplode(F.concat(header, X.chunk_text(F.col("content"), size, overlap))).alias("seq", "text"))


def write_gate(new: DataFrame, nearest: DataFrame, decide: Column | None = None, threshold: float = 0.92) -> DataFrame:
    """DML-15: what to do with new notes that have a near one (id, other, cosine): ADD, UPDATE, DELETE or NOOP.

    ``decide`` is a column over the joined rows, for instance a pandas UDF around a local model; without one, or where
    it gives anything else, the answer is ADD.
    """
    rows = new.join(nearest.where(F.col("cosine") >= threshold), "id", "left")
    said = F.lit(None).cast("string") if decide is None else F.upper(decide)
    return rows.withColumn("decision", F.when(F.col("other").isNotNull() & said.isin("UPDATE", "DELETE", "NOOP"), said).otherwise("ADD"))
