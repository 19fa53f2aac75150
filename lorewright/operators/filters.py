"""Filters, policies, scans with paging, set operations and windows (FLT-*, SRC-01 to SRC-08, SET-*, WIN-*, SRT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(notes: DataFrame, *, trash: bool = False, type: str | None = None, scope: str | None = None, tag: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """SRC-01, SRC-02, FLT-02: one page, newest first; without a limit the whole table."""
    out = notes.where(F.col("deleted_at").isNotNull() if trash else F.col("deleted_at").isNull())
    for name, value in (("type", type), ("scope", scope)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag.lower()))
    out = out.orderBy(F.desc("updated_at"), "id")
    return out if limit is None else out.offset(max(0, offset)).limit(max(1, limit))


def multi_get(notes: DataFrame, ids: list[str]) -> DataFrame:
    """SRC-03, SRC-04: the notes of the ids, in the order asked for, each once."""
    asked = notes.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "id string, pos int")
    return notes.join(F.broadcast(asked), "id").orderBy("pos")


def by_title(notes: DataFrame, title: str) -> DataFrame:
    """SRC-05: the newest live note of a title."""
    return notes.where(F.col("deleted_at").isNull() & (F.col("title") == title)).orderBy(F.desc("updated_at"), "id").limit(1)


def history(versions: DataFrame, memory_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """SRC-08: one page of versions, newest first, with the total."""
    rows = versions.where(F.col("memory_id") == memory_id)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("created_at"), F.desc("version_id")).offset(offset).limit(min(200, limit)).crossJoin(F.broadcast(total))


def text_filter(q: str) -> Column:
    """FLT-05: title, content or a tag contains the words, whatever the letter case."""
    low = q.lower()
    return F.lower("title").contains(low) | F.lower("content").contains(low) | F.exists("tags", lambda t: F.lower(t).contains(low))


def facets(tags_all: list[str], carriers: list[str], topics_any: list[str]) -> Column:
    """FLT-06: all of the tags, one of the carriers, any of the topics; empty lists ask for nothing."""
    keep = F.lit(True)
    if tags_all:
        keep = keep & (F.size(F.array_except(F.array(*[F.lit(t) for t in tags_all]), F.col("tags"))) == 0)
    if carriers:
        keep = keep & F.col("carrier").isin(carriers)
    if topics_any:
        keep = keep & F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics_any]))
    return keep


def private_floor(notes: DataFrame, mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FLT-07: what an agent may see: no private notes, no pointers to them, no concepts or edges that only they carry."""
    private = notes.where("scope = 'private'").select("id")
    rows = notes.join(private, "id", "left_anti")
    hidden = private.select(F.col("id").alias("superseded_by"), F.lit(True).alias("__hidden"))
    rows = rows.join(hidden, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("__hidden").isNull(), F.col("superseded_by"))).select(*notes.columns)
    gone = private.withColumnRenamed("id", "memory_id")
    seen = mentions.join(gone, "memory_id", "left_anti")
    return rows, seen.select("entity").distinct(), edges.join(gone, "memory_id", "left_anti")


def team_access(rows: DataFrame, roles: DataFrame | None, default_role: str = "viewer") -> DataFrame:
    """FLT-09: rows (actor, scope, ...) with ``can_read`` and ``can_write``; team scopes need a role table, writing a role above viewer."""
    team = F.col("scope").startswith("team:")
    if roles is None:
        return rows.withColumn("can_read", ~team).withColumn("can_write", ~team)
    known = rows.join(roles.select("actor", "role"), "actor", "left").withColumn("role", F.coalesce("role", F.lit(default_role)))
    return known.withColumn("can_read", F.lit(True)).withColumn("can_write", ~team | F.col("role").isin("admin", "member"))


#: Folders and files that a scan never reads, and what it can read.
SECRET_FOLDERS = [".ssh", ".gnupg", ".aws", ".kube", "keychains", "secrets"]
SKIPPED_FOLDERS = ["node_modules", "library", "system", "windows", "program files", "cache", "caches", "tmp", "dist", "build", "venv", "__pycache__"]
SECRET_FILES = r"^(\.env.*|id_rsa.*|id_ed25519.*|.*\.pem|.*\.key|.*\.p12|.*\.keychain.*|credentials.*|.*\.kdbx)$"
READABLE = [".md", ".txt", ".pdf", ".docx", ".xlsx", ".html", ".csv", ".json", ".xml", ".yaml", ".yml", ".eml", ".log", ".rtf", ".py", ".ts", ".js", ".sql"]


def verdict(path: Column, size: Column, deselected: list[str] | None = None, endings: list[str] | None = None, most: int = 20 * 1024 * 1024, root: str | None = None) -> Column:
    """FLT-10, SRC-17, SRC-26: why a file is not read, the first reason that holds; null where it is.

    Folders above ``root``, the one the user chose, are not judged.
    """
    low = F.lower(path)
    if root:
        at = F.instr(low, root.lower().rstrip("/"))
        low = F.when(at > 0, F.substring(low, at + len(root.rstrip("/")), F.length(low))).otherwise(low)
    parts = F.filter(F.split(low, r"[\\/]"), lambda x: x != "")
    folders, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    ending = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    allowed = [e for e in (endings or READABLE) if e in READABLE]
    return (
        F.when(F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SECRET_FOLDERS])) | name.rlike(SECRET_FILES), "secret")
        .when(F.exists(folders, lambda x: x.isin(SKIPPED_FOLDERS)), "system folder")
        .when(F.exists(folders, lambda x: x.isin([d.lower() for d in deselected or ["\0"]])), "deselected")
        .when(name.startswith("."), "hidden")
        .when(~ending.isin(allowed), "format")
        .when(size > most, "too big")
        .when(size <= 0, "empty")
    )


def folder_histogram(files: DataFrame, root: str, most: int = 20) -> DataFrame:
    """AGG-19: (folder, n, endings): first folder below the root, files in it, up to four of their endings."""
    below = F.substring("path", len(root) + 2, 10_000)
    rows = files.select(F.element_at(F.split(below, "/"), 1).alias("folder"), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("e"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("e")), 1, 4), ",").alias("endings")).orderBy(F.desc("n"), "folder").limit(most)


def audit_page(log: DataFrame, *, actor: str | None = None, action: str | None = None, text: str | None = None, before: int | None = None, limit: int = 100) -> DataFrame:
    """FLT-11: one page, newest first, by key; ``more`` says whether another follows."""
    limit = max(1, min(500, limit))
    rows = log
    for name, value in (("actor", actor), ("action", action)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if text:
        rows = rows.where(F.lower(F.coalesce("target", F.lit(""))).contains(text.lower()) | F.lower(F.coalesce("detail", F.lit(""))).contains(text.lower()))
    if before is not None:
        rows = rows.where(F.col("id") < before)
    page = rows.orderBy(F.desc("id")).limit(limit + 1)
    more = page.agg((F.count("*") > limit).alias("more"))
    return page.orderBy(F.desc("id")).limit(limit).crossJoin(F.broadcast(more))


def activity_feed(log: DataFrame, notes: DataFrame, after: int = 0, limit: int = 100) -> DataFrame:
    """SRC-23: newest first after a cursor; the text is the live note's title where there is one."""
    page = log.where(F.col("id") > after).orderBy(F.desc("id")).limit(limit)
    live = notes.where("deleted_at IS NULL").select(F.col("id").alias("memory_id"), "title")
    return page.join(live, "memory_id", "left").select("id", "at", "client", "tool", F.coalesce("title", "text").alias("text"), "memory_id").orderBy(F.desc("id"))


def ring(log: DataFrame, keep: int = 500) -> DataFrame:
    """WIN-04, STM-03: the newest ``keep`` rows."""
    return log.orderBy(F.desc("id")).limit(keep)


def timeline(rows: DataFrame) -> DataFrame:
    """WIN-08, RPT-05: (n, day, gap, span): the days of dated rows, days since the one before, and the whole span."""
    days = rows.select(F.to_date(F.timestamp_millis("at")).alias("day")).distinct()
    w = Window.orderBy("day")  # one row per day
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    out = days.withColumn("n", F.row_number().over(w)).withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    return out.crossJoin(F.broadcast(ends)).select("n", "day", "gap", F.datediff("last", "first").alias("span"))


def group_window(groups: DataFrame, budget: int) -> DataFrame:
    """SRT-08: whole groups (rank, key, size) are shown while rows of the budget are left; the first always."""
    total = F.sum("size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("total", total).where((F.col("total") <= budget) | (F.col("rank") == 1))


def list_groups(notes: DataFrame, mode: str, now_ms: int) -> DataFrame:
    """CLS-08: (key, id): the groups of a list by file, topic (a note may be in several), type or period."""
    from ..functions import classify as C
    from ..functions import numbers as N
    from ..functions import text as X

    if mode == "file":
        notes = notes.select("id", F.explode(F.array(X.source_of(F.col("content")))).alias("s"))  # found once for all its uses
        s = F.col("s")
        inbox = s["path"].startswith("inbox ")
        key = F.when(s["kind"] == "none", "none").when(inbox, F.concat(F.lit("inbox:"), F.regexp_replace(s["path"], "^inbox ", ""))).otherwise(F.concat(s["kind"], F.lit(":"), s["path"]))
    elif mode == "topic":
        found = C.topics(F.col("title"), F.col("content"), C.carrier(F.coalesce("content", F.lit("")), F.col("tags"), F.lit(None).cast("string")))
        notes = notes.select("id", F.explode(F.array(found)).alias("found"))
        key = F.explode(C.topic_bucket(F.col("found")))
    elif mode == "type":
        key = F.concat(F.lit("type:"), F.coalesce("type", F.lit("semantic")))
    elif mode == "period":
        key = N.list_period(F.col("created_at"), now_ms)
    else:
        raise ValueError(f"groups are by file, topic, type or period: {mode!r}")
    return notes.select(key.alias("key"), "id")


def locale_order(c: Column, collation: str = "UNICODE") -> Column:
    """SRT-06: the order of words in a dictionary: letters first, then accents, then letter case."""
    return F.collate(c, collation)


def age_page(notes: DataFrame, bucket: Column, wanted: str, limit: int = 20) -> DataFrame:
    """RPT-06: the newest notes of an age bucket and how many remain behind them."""
    rows = notes.where(bucket == wanted)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit).crossJoin(F.broadcast(total)).select("id", "title", "updated_at", F.greatest(F.col("total") - limit, F.lit(0)).alias("remaining"))
