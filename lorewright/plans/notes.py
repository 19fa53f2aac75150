"""Registered scan, filter, window and lifecycle queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import filters as L
from ..operators import graph as G
from ..operators import lifecycle as D
from ..sources.tables import ACTIVITY_SQL, CHUNKS_SQL, MENTIONS_SQL, NOTES_SQL, NOW_MS, active, activity, chunks, mentions, notes
from .texts import chunks_sql, type_sql


def _n():
    return F.substring("id", 2, 20).cast("long")


def src_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listed(notes(spark, sf_dir), type="semantic", tag="EN", limit=20, offset=5).select("id", "title", "updated_at")


def src_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listed(notes(spark, sf_dir), trash=True, limit=None).select("id", "deleted_at")


def src_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.multi_get(notes(spark, sf_dir), ["d7", "d3", "d7", "d12", "nope", "d1"]).select("pos", "id", "title")


def src_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).withColumn("title", F.when(_n() % 9 == 0, "weekly").otherwise(F.col("title")))
    return L.by_title(rows, "weekly").select("id", "title")


def src_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = notes(spark, sf_dir).select(F.concat(F.lit("d"), _n() % 5).alias("memory_id"), _n().alias("version_id"), "title", "created_at")
    return L.history(versions, "d3", 10, 5)


def src_pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).join(active(notes(spark, sf_dir)).select(F.col("id").alias("memory_id")), "memory_id", "left_semi").groupBy("model").agg(F.count("*").alias("n"))


def src_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22, DML-17."""
    rows = notes(spark, sf_dir).select(F.concat(F.lit("k"), _n()).alias("key"), F.col("title").alias("value"))
    changes = rows.select("key", F.when(F.substring("key", -1, 1) != "3", "new").alias("value")).where("substring(key, -1, 1) IN ('3', '4')")
    return D.settings(rows, changes).orderBy("key")


def flt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).where(L.text_filter("LICENSE")).select("id")


def flt_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).withColumn("carrier", F.when(_n() % 2 == 0, "notes").otherwise("files")).withColumn("topics", F.array(F.when(_n() % 3 == 0, "tasks").otherwise("links")))
    return rows.where(L.facets(["en"], ["notes"], ["tasks", "people"])).select("id")


def flt_active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03, FLT-04."""
    return notes(spark, sf_dir).where(N.visible_at(F.col("valid_from"), F.col("created_at"), F.col("valid_to"), 1704500000000)).select("id")


def flt_edge_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = N.visible_at(F.col("valid_from"), F.col("created_at"), F.col("valid_to"), 1704500000000)
    return notes(spark, sf_dir).agg(F.count_if(G.edge_visible(on, F.lit(True), F.col("valid_from"), F.col("valid_to"), 1704500000000)).alias("n"))


def flt_private_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    rows, entities, edges = L.private_floor(notes(spark, sf_dir), m, m.select("memory_id", F.col("entity").alias("source")))
    return rows.agg(F.count("*").alias("notes"), F.count("superseded_by").alias("pointers")).crossJoin(entities.agg(F.count("*").alias("entities"))).crossJoin(edges.agg(F.count("*").alias("edges")))


def flt_team_rbac(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame([("src1", "admin"), ("src2", "member"), ("src3", "viewer")], "actor string, role string")
    rows = notes(spark, sf_dir).select(F.element_at("tags", 2).alias("actor"), "scope")
    return L.team_access(rows, roles).groupBy("scope", "can_read", "can_write").agg(F.count("*").alias("n"))


def flt_scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20 over FLT-10."""
    folder = F.element_at(F.array(*[F.lit(x) for x in ("docs", ".ssh", "node_modules", "private", "docs", "docs", "docs")]), (_n() % 7 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.md", ".hidden.md", "b.xyz", "c.txt", "id_rsa")]), (_n() % 5 + 1).cast("int"))
    size = F.when(_n() % 11 == 0, 0).when(_n() % 13 == 0, 30_000_000).otherwise(F.length("content"))
    rows = notes(spark, sf_dir).select(L.verdict(F.concat_ws("/", F.lit("/home/u"), folder, name), size, ["private"]).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def agg_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).select(F.concat(F.lit("/root/"), F.element_at("tags", 2), F.lit("/"), "id", F.when(_n() % 2 == 0, ".md").otherwise(".txt")).alias("path"))
    return L.folder_histogram(rows, "/root")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).select("id", "at", F.col("client").alias("actor"), F.col("tool").alias("action"), F.col("memory_id").alias("target"), F.col("text").alias("detail"))


def flt_audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.audit_page(_log(spark, sf_dir), actor="client-3", text="7", before=800, limit=20)


def src_activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.activity_feed(activity(spark, sf_dir), notes(spark, sf_dir), 10, 40)


def win_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ring(activity(spark, sf_dir)).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def win_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.timeline(active(notes(spark, sf_dir)).where("scope = 'team:alpha'").select(F.col("created_at").alias("at"))).withColumn("day", F.col("day").cast("string"))


def srt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = notes(spark, sf_dir).groupBy(F.element_at("tags", 2).alias("key")).agg(F.count("*").alias("size"))
    return L.group_window(rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "key"))), 60)


def rpt_age_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    return L.age_page(rows, N.age_bucket(F.col("updated_at"), NOW_MS), "older", 5)


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = notes(spark, sf_dir).where(_n() % 2 == 0)
    new = notes(spark, sf_dir).where(_n() % 3 == 0).withColumn("type", F.when(_n() % 2 == 1, "odd").otherwise(F.col("type"))).withColumn("confidence", F.col("confidence") + 0.4)
    snapshot, turned = D.insert(old, D.prepared(new, NOW_MS))
    return snapshot.agg(F.count("*").alias("notes"), F.round(F.sum("confidence"), 6).alias("confidence")).crossJoin(turned.agg(F.count("*").alias("turned_away")))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).where(_n() % 4 == 0).select(F.when(_n() % 8 == 0, F.concat(F.lit("new"), _n())).otherwise(F.col("id")).alias("id"), F.when(_n() % 3 == 0, F.concat(F.lit("x "), "title")).alias("title"), F.when(_n() % 5 == 0, F.lit("replaced")).alias("content"))


def dml_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge(notes(spark, sf_dir), _patches(spark, sf_dir), ["title", "content"], NOW_MS).select("id", "title", F.length("content").alias("n"), "created_at", "updated_at")


def dml_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.versions(notes(spark, sf_dir), _patches(spark, sf_dir), NOW_MS).select("memory_id", "title", F.length("content").alias("n"), "created_at")


def dml_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-08, DML-19."""
    rows = chunks(spark, sf_dir)
    fresh = rows.where("memory_id LIKE '%5'").withColumn("seq", F.col("seq") + 1)
    replaced = D.replace_chunks(D.stale_chunks(rows, notes(spark, sf_dir), _patches(spark, sf_dir)), fresh)
    return D.set_vectors(replaced, replaced.where("memory_id LIKE '%7'").withColumn("model", F.lit("m9"))).groupBy("model", "seq").agg(F.count("*").alias("n"))


def dml_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    out = D.trash(D.trash(rows, rows.where("id LIKE '%2'"), NOW_MS), rows.where("id LIKE '%12'"), None)
    left = D.purge(out, [(chunks(spark, sf_dir), "memory_id")], out.where("deleted_at IS NOT NULL"))
    return left[0].agg(F.count("*").alias("notes")).crossJoin(left[1].agg(F.count("*").alias("chunks")))


def dml_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    mode = F.element_at(F.array(*[F.lit(x) for x in ("expire", "supersede", "delete", "window")]), (_n() % 4 + 1).cast("int"))
    orders = rows.where(_n() % 3 == 0).select("id", mode.alias("mode"), F.lit("d1").alias("by"), (F.col("created_at") + (_n() % 5 - 2) * 1000).alias("at"))
    return D.forget(rows, orders, NOW_MS).select("id", "valid_to", "superseded_by", "deleted_at")


def dml_access_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity(spark, sf_dir).select(F.col("memory_id").alias("id"), (F.col("id") % 50).alias("call"), "at")
    return D.record_access(notes(spark, sf_dir), log).select("id", "access_count", "last_access_at")


def dml_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity(spark, sf_dir).select(F.col("memory_id").alias("id"), F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, -0.4).otherwise(0.25).alias("delta"))
    return D.reinforce(notes(spark, sf_dir), log).select("id", F.round("utility", 6).alias("utility"))


def dml_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    history = rows.where("id LIKE '%3'").select(F.col("id").alias("memory_id"), F.lit(1).alias("version_id"), F.concat(F.lit("old "), "title").alias("title"), "content")
    table, kept = D.restore_version(rows, history, history.select(F.col("memory_id").alias("id"), "version_id"), NOW_MS)
    return table.where("title LIKE 'old %'").agg(F.count("*").alias("restored")).crossJoin(kept.agg(F.count("*").alias("versions")))


def dml_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = notes(spark, sf_dir).where("id LIKE '%4'").select(F.when(F.length("id") > 2, F.col("id")).otherwise("nope").alias("id"))
    return D.bulk(notes(spark, sf_dir), ids.unionAll(ids))


def dml_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reclassify(active(notes(spark, sf_dir)))


def dml_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    old = rows.where(_n() % 3 > 0).select(F.element_at("tags", 2).alias("file"), "id", _n().alias("n"))
    new = rows.where(_n() % 2 == 0).select(F.element_at("tags", 2).alias("file"), _n().alias("n"), F.col("title").alias("content"))
    return D.repair_plan(old, new).groupBy("file", "action").agg(F.count("*").alias("n"))


def dml_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = activity(spark, sf_dir).select(F.concat_ws("|", "client", "memory_id").alias("key"), "at")
    return D.accepted_pairs(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"), 300)


def dml_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.indexed_chunks(notes(spark, sf_dir)).groupBy("memory_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith(("src_", "flt_", "agg_", "win_", "srt_", "rpt_", "dml_"))}

_N = f"WITH {NOTES_SQL}"
_V = "coalesce(valid_from, created_at) <= 1704500000000 AND (valid_to IS NULL OR valid_to > 1704500000000)"
_PAT = "pat AS (SELECT CASE WHEN doc_id % 8 = 0 THEN 'new' || doc_id ELSE id END AS id, CASE WHEN doc_id % 3 = 0 THEN 'x ' || title END AS title, CASE WHEN doc_id % 5 = 0 THEN 'replaced' END AS content FROM notes WHERE doc_id % 4 = 0)"
ORACLE = {
    "dml_reclassify": f"{_N}, live AS (SELECT * FROM notes WHERE deleted_at IS NULL), {type_sql('live')}, h AS (SELECT type, 1 AS b, 0 AS a FROM r UNION ALL SELECT k[1], 0, 1 FROM r) SELECT type, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM h GROUP BY type",
    "dml_index": f"{_N}, k AS (SELECT id, list_concat([title || chr(10) || array_to_string(tags, ' ')], {chunks_sql('content')}) AS k FROM notes) SELECT id AS memory_id, len(k) AS n, list_max(list_transform(k, lambda x: len(x))) AS longest FROM k",
    "src_list": f"{_N} SELECT id, title, updated_at FROM notes WHERE deleted_at IS NULL AND type = 'semantic' AND list_contains(tags, 'en') ORDER BY updated_at DESC, id LIMIT 20 OFFSET 5",
    "src_all": f"{_N} SELECT id, deleted_at FROM notes WHERE deleted_at IS NOT NULL",
    "src_multi_get": f"{_N}, a(id, pos) AS (VALUES ('d7', 0), ('d3', 1), ('d12', 2), ('nope', 3), ('d1', 4)) SELECT pos, id, title FROM a JOIN notes USING (id)",
    "src_by_title": f"{_N} SELECT id, 'weekly' AS title FROM notes WHERE doc_id % 9 = 0 AND deleted_at IS NULL ORDER BY updated_at DESC, id LIMIT 1",
    "src_history": f"{_N}, v AS (SELECT doc_id AS version_id, title, created_at FROM notes WHERE doc_id % 5 = 3) SELECT 'd3' AS memory_id, version_id, title, created_at, (SELECT count(*) FROM v) AS total FROM v ORDER BY created_at DESC, version_id DESC LIMIT 10 OFFSET 5",
    "src_pending_chunks": f"{_N}, {CHUNKS_SQL} SELECT model, count(*) AS n FROM chunks WHERE memory_id IN (SELECT id FROM notes WHERE deleted_at IS NULL) GROUP BY model",
    "src_settings": f"{_N} SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 10 = 4 THEN 'new' ELSE title END AS value FROM notes WHERE doc_id % 10 <> 3",
    "flt_text": f"{_N} SELECT id FROM notes WHERE contains(lower(title), 'license') OR contains(lower(content), 'license')",
    "flt_facets": f"{_N} SELECT id FROM notes WHERE tags[1] = 'en' AND doc_id % 2 = 0 AND doc_id % 3 = 0",
    "flt_active_at": f"{_N} SELECT id FROM notes WHERE {_V}",
    "flt_edge_visible": f"{_N} SELECT count(*) AS n FROM notes WHERE {_V} AND (valid_from IS NULL OR valid_from <= 1704500000000)",
    "flt_private_floor": f"{_N}, {MENTIONS_SQL}, pv AS (SELECT id FROM notes WHERE scope = 'private'), e AS (SELECT * FROM mentions WHERE memory_id NOT IN (SELECT id FROM pv)) SELECT count(*) AS notes, count(CASE WHEN superseded_by NOT IN (SELECT id FROM pv) THEN 1 END) AS pointers, (SELECT count(DISTINCT entity) FROM e) AS entities, (SELECT count(*) FROM e) AS edges FROM notes WHERE scope <> 'private'",
    "flt_team_rbac": f"{_N} SELECT scope, true AS can_read, NOT starts_with(scope, 'team:') OR tags[2] IN ('src1', 'src2') AS can_write, count(*) AS n FROM notes GROUP BY ALL",
    "flt_scan_verdict": f"""{_N} SELECT CASE WHEN doc_id % 7 = 1 OR doc_id % 5 = 4 THEN 'secret' WHEN doc_id % 7 = 2 THEN 'system folder' WHEN doc_id % 7 = 3 THEN 'deselected' WHEN doc_id % 5 = 1 THEN 'hidden' WHEN doc_id % 5 = 2 THEN 'format'
WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'too big' WHEN doc_id % 11 = 0 OR len(content) = 0 THEN 'empty' END AS reason, count(*) AS n FROM notes GROUP BY 1""",
    "agg_folders": f"{_N} SELECT tags[2] AS folder, count(*) AS n, string_agg(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END, ',' ORDER BY CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END) AS endings FROM notes GROUP BY 1 ORDER BY n DESC, folder LIMIT 20",
    "flt_audit_page": f"""WITH {ACTIVITY_SQL}, r AS (SELECT id, "at", client AS actor, tool AS action, memory_id AS target, text AS detail FROM activity WHERE client = 'client-3' AND id < 800 AND (contains(lower(memory_id), '7') OR contains(lower(text), '7'))) SELECT *, (SELECT count(*) > 20 FROM r) AS more FROM r ORDER BY id DESC LIMIT 20""",
    "src_activity_feed": f"""{_N}, {ACTIVITY_SQL}, p AS (SELECT * FROM activity WHERE id > 10 ORDER BY id DESC LIMIT 40) SELECT p.id, "at", client, tool, coalesce(title, text) AS text, memory_id FROM p LEFT JOIN notes ON notes.id = memory_id AND deleted_at IS NULL""",
    "win_ring": "SELECT least(500, count(*)) AS n, greatest(min(event_id), max(event_id) - 499) AS first, max(event_id) AS last FROM events",
    "win_timeline": f"{_N}, d AS (SELECT DISTINCT make_timestamp_ms(created_at)::DATE AS day FROM notes WHERE deleted_at IS NULL AND scope = 'team:alpha') SELECT row_number() OVER (ORDER BY day) AS n, day::VARCHAR AS day, day - lag(day) OVER (ORDER BY day) AS gap, (SELECT max(day) - min(day) FROM d) AS span FROM d",
    "srt_groups": f"{_N}, g AS (SELECT tags[2] AS key, count(*) AS size FROM notes GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, key) AS rank FROM g), t AS (SELECT *, sum(size) OVER (ORDER BY rank)::BIGINT AS total FROM r) SELECT * FROM t WHERE total <= 60 OR rank = 1",
    "rpt_age_page": f"{_N}, o AS (SELECT * FROM notes WHERE ({NOW_MS} - updated_at) / 86400000.0 >= 28) SELECT id, title, updated_at, greatest((SELECT count(*) FROM o) - 5, 0) AS remaining FROM o ORDER BY updated_at DESC, id LIMIT 5",
    "dml_insert": f"{_N} SELECT count(*) FILTER (WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) AS notes, round(sum(CASE WHEN doc_id % 2 = 0 THEN confidence WHEN doc_id % 3 = 0 THEN least(1, confidence + 0.4::DOUBLE) END), 6) AS confidence, count(*) FILTER (WHERE doc_id % 6 = 0) AS turned_away FROM notes",
    "dml_upsert_merge": f"{_N}, {_PAT} SELECT coalesce(n.id, p.id) AS id, coalesce(p.title, n.title) AS title, len(coalesce(p.content, n.content)) AS n, CASE WHEN n.id IS NULL THEN {NOW_MS} ELSE created_at END AS created_at, CASE WHEN p.id IS NOT NULL THEN {NOW_MS} ELSE updated_at END AS updated_at FROM notes n FULL JOIN pat p ON n.id = p.id",
    "dml_versions": f"{_N}, {_PAT} SELECT n.id AS memory_id, n.title, len(n.content) AS n, {NOW_MS} AS created_at FROM notes n JOIN pat p ON n.id = p.id WHERE coalesce(p.title <> n.title, false) OR coalesce(p.content <> n.content, false)",
    "dml_chunks": f"{_N}, {CHUNKS_SQL}, {_PAT}, ch AS (SELECT n.id FROM notes n JOIN pat p ON n.id = p.id WHERE p.content <> n.content), r AS (SELECT memory_id, seq, model FROM chunks WHERE memory_id NOT IN (SELECT id FROM ch) AND memory_id NOT LIKE '%5' UNION ALL SELECT memory_id, seq + 1, model FROM chunks WHERE memory_id LIKE '%5') SELECT CASE WHEN memory_id LIKE '%7' THEN 'm9' ELSE model END AS model, seq, count(*) AS n FROM r GROUP BY ALL",
    "dml_trash": f"{_N}, {CHUNKS_SQL}, g AS (SELECT id FROM notes WHERE CASE WHEN id LIKE '%12' THEN false WHEN id LIKE '%2' THEN true ELSE deleted_at IS NOT NULL END) SELECT (SELECT count(*) FROM notes WHERE id NOT IN (SELECT id FROM g)) AS notes, (SELECT count(*) FROM chunks WHERE memory_id NOT IN (SELECT id FROM g)) AS chunks",
    "dml_forget": f"""{_N}, o AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN ['expire', 'supersede', 'delete', 'window'][doc_id % 4 + 1] END AS mode, created_at + (doc_id % 5 - 2) * 1000 AS moment FROM notes)
SELECT id, CASE WHEN mode = 'expire' THEN {NOW_MS} WHEN mode = 'window' AND moment > coalesce(valid_from, created_at) THEN moment ELSE valid_to END AS valid_to, CASE WHEN mode = 'supersede' THEN 'd1' ELSE superseded_by END AS superseded_by, CASE WHEN mode = 'delete' THEN {NOW_MS} ELSE deleted_at END AS deleted_at FROM o""",
    "dml_access_fold": f"""{_N}, {ACTIVITY_SQL}, s AS (SELECT memory_id, count(DISTINCT id % 50) AS n, max("at") AS "at" FROM activity GROUP BY 1) SELECT id, access_count + coalesce(n, 0) AS access_count, coalesce("at", last_access_at) AS last_access_at FROM notes LEFT JOIN s ON id = memory_id""",
    "dml_reinforce": f"""WITH RECURSIVE {NOTES_SQL}, {ACTIVITY_SQL}, s AS (SELECT memory_id, CASE WHEN id % 3 = 0 THEN -0.4::DOUBLE ELSE 0.25::DOUBLE END AS d, row_number() OVER (PARTITION BY memory_id ORDER BY id) AS k FROM activity),
f AS (SELECT id, 0::BIGINT AS k, utility AS u FROM notes UNION ALL SELECT f.id, s.k, greatest(0::DOUBLE, least(1::DOUBLE, u + d)) FROM f JOIN s ON s.memory_id = f.id AND s.k = f.k + 1)
SELECT id, round(max_by(u, k), 6) AS utility FROM f GROUP BY id""",
    "dml_restore": f"{_N} SELECT count(*) AS restored, count(*) AS versions FROM notes WHERE id LIKE '%3'",
    "dml_bulk": f"{_N}, i AS (SELECT DISTINCT CASE WHEN len(id) > 2 THEN id ELSE 'nope' END AS id FROM notes WHERE id LIKE '%4') SELECT count(*) AS named, count(*) FILTER (WHERE id <> 'nope') AS changed, count(*) FILTER (WHERE id = 'nope') AS not_found FROM i",
    "dml_repair_plan": f"""{_N}, a AS (SELECT tags[2] AS file, id, row_number() OVER (PARTITION BY tags[2] ORDER BY doc_id, id) AS pos FROM notes WHERE doc_id % 3 > 0), b AS (SELECT tags[2] AS file, title, row_number() OVER (PARTITION BY tags[2] ORDER BY doc_id) AS pos FROM notes WHERE doc_id % 2 = 0)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN id IS NULL THEN 'insert' WHEN title IS NULL THEN 'drop' ELSE 'update' END AS action, count(*) AS n FROM a FULL JOIN b ON a.file = b.file AND a.pos = b.pos GROUP BY ALL""",
    "dml_accepted": f"""WITH {ACTIVITY_SQL} SELECT client || '|' || memory_id AS key, max("at") AS "at" FROM activity GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300""",
}
