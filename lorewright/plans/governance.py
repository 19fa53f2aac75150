"""Registered security, import and export queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import secure as S
from ..sources import imports as I
from ..sources.tables import ACTIVITY_SQL, NOTES_SQL, NOW_MS, active, activity, notes, table
from .texts import _clean, _html_sql, type_sql, unusable_sql

_KEY = bytes(range(32))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).select("id", "at", F.col("client").alias("actor"), F.col("tool").alias("action"), F.col("memory_id").alias("target"), F.col("text").alias("detail"))


def sec_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain per actor; one entry of client-3 is changed after sealing, so its chain is broken there."""
    sealed = S.chain(_log(spark, sf_dir))
    bent = sealed.withColumn("action", F.when(F.col("id") == 27, F.lit("x")).otherwise(F.col("action")))
    return S.verify(bent)


def sec_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = S.chain(_log(spark, sf_dir))
    heads = sealed.groupBy("actor").agg((F.count("*") + F.when(F.col("actor") == "client-5", 1).otherwise(0)).alias("entries"), F.max_by("hash", "id").alias("hash"))
    return S.against_head(S.verify(sealed), sealed, heads)


def sec_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEC-05: seals of single entries over a fixed previous one."""
    return _log(spark, sf_dir).select("id", S.seal(F.lit("0"), F.col("at"), F.col("actor"), F.col("action"), F.when(F.col("id") % 3 > 0, F.col("target")), F.col("detail")).alias("hash"))


def sec_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("content"), F.lit(" sk-ant-"), F.lpad("id", 20, "a"), F.lit(" ghp_"), F.lpad("id", 18, "b"), F.lit(" api_key: "), F.sha2("id", 256))
    masked = S.mask(text)
    return notes(spark, sf_dir).select("id", F.length(masked).alias("n"), F.md5(masked.cast("binary")).alias("masked_md5"), S.masked_count(text).alias("keys"))


def sec_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contents, with an address, an account number (one in 98 is sound) and a telephone number behind each."""
    n = F.substring("id", 2, 20).cast("long")
    account = F.concat(F.lit("DE"), F.lpad((n % 98).cast("string"), 2, "0"), F.lit("500105170123"), F.lpad((n % 1000000).cast("string"), 6, "0"))
    text = F.concat("content", F.lit(" write a"), "id", F.lit("@mail.example.org, account "), account, F.lit(", call +49 170 1234567 today"))
    return notes(spark, sf_dir).select("id", F.explode(S.search_udf(text)).alias("f")).select("id", "f.*")


def sec_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("content", F.lit(" ask ann@x.org or b"), "id", F.lit("@x.org, then ann@x.org"))
    return notes(spark, sf_dir).where("content IS NOT NULL").select("id", S.pseudonyms_udf(text).alias("h")).select("id", F.md5(F.col("h.text").cast("binary")).alias("text_md5"), F.size("h.names").alias("names"))


def sec_private_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a <private>x\ny</private> b "), "title")
    return notes(spark, sf_dir).select("id", S.without_private(text).alias("text"))


def sec_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    host = F.element_at(F.array(*[F.lit(x) for x in ("127.0.0.1", "10.1.2.3", "[::1]", "2130706433", "8.8.8.8", "0x7f000001")]), (n % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", S.blocked_url(F.when(n % 2 == 0, F.concat(F.lit("http://"), host, F.lit("/x"))).otherwise(F.col("url"))).alias("blocked"))


def sec_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    return S.guard(rows, ["memory_delete"], "memory_search").select("id").unionAll(S.guard(rows, ["memory_delete"], "memory_delete").select("id"))


def sec_audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEC-10 to SEC-12."""
    rows = activity(spark, sf_dir)
    a = S.call_to_audit(F.col("tool"), F.col("memory_id"), F.col("text"), F.array("memory_id", "client"))
    path = F.when(F.col("id") % 4 == 0, "/api/memories").when(F.col("id") % 4 == 1, "/api/memories/x").otherwise("/api/search")
    return rows.select("id", a["action"].alias("action"), a["detail"].alias("detail"), S.route_to_audit(F.when(F.col("id") % 2 == 0, "POST").otherwise("DELETE"), path).alias("route"), S.call_to_activity(F.col("tool"), F.col("text"), F.lit(3)).alias("line"))


def sec_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = spark.createDataFrame([('{"default":"viewer","roles":{"ann":"admin","bo":"member","cy":"king"}}',)], "json string")
    return S.roles_of(doc)


def sec_bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, SRC-20: what is encrypted and decrypted is what it was."""
    rows = I.bundle(notes(spark, sf_dir), "team:alpha").withColumn("b", S.encrypted(F.col("line"), _KEY))
    return rows.select("id", (S.decrypted(F.col("b"), _KEY) == F.col("line")).alias("same"))


def sec_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.readers(_log(spark, sf_dir), "d7")


def str_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("claude-desktop", "OpenAI app", "cursor 1.2", "my tool", " ")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(S.client_name(name).alias("who")).agg(F.count("*").alias("n"))


def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [S.csv_cell(F.col(c)) for c in ("id", "actor", "action", "detail")]
    rows = _log(spark, sf_dir).withColumn("actor", F.when(F.col("id") % 5 == 0, F.concat(F.lit("="), "actor")).otherwise(F.col("actor")))
    return rows.select("id", F.concat_ws(",", *cells).alias("line"))


def snk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.to_markdown(notes(spark, sf_dir))
    return rows.select("id", "file", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def snk_markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, SRC-10, SNK-01: exported notes read back as they were."""
    rows = notes(spark, sf_dir)
    files = I.to_markdown(rows).select(F.regexp_replace("file", r"\.md$", "").alias("name"), "text")
    back = I.notes_of_markdown(files, NOW_MS)
    both = back.alias("b").join(rows.alias("n"), "id").select("id", (F.col("b.title") == F.col("n.title")).alias("title"), (F.col("b.content") == F.regexp_replace("n.content", r"^\s+|\s+$", "")).alias("content"), (F.col("b.created_at") == F.col("n.created_at")).alias("created"))
    return both.groupBy("title", "content", "created").agg(F.count("*").alias("n"))


def snk_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.bundle(notes(spark, sf_dir), "team:alpha").select("id")


def snk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = active(notes(spark, sf_dir)).orderBy(F.desc("updated_at"), "id").limit(5)
    page = rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id"))).select("pos", "id", F.regexp_replace("title", r"[^A-Za-z ]", "").alias("title"))
    return I.json_page(page, active(notes(spark, sf_dir)).agg(F.count("*").alias("total")))


def snk_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.expired_backups(notes(spark, sf_dir).select(F.col("id").alias("name"), F.col("updated_at").alias("at")), 100)


def src_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_turns(table(spark, sf_dir, "conversations")).select("id", "conv_id", "turn", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def src_conversations_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.conversation_notes(table(spark, sf_dir, "conversations")).select("conv_id", "title", "turns", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def src_chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as export trees, read back along their chains."""
    rows = table(spark, sf_dir, "conversations")
    node = F.struct(F.when(F.col("turn") > 0, F.concat(F.lit("n"), F.col("turn") - 1)).alias("parent"), F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))
    trees = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "turn"), node))).alias("mapping"), F.concat(F.lit("n"), F.max("turn")).alias("current_node"))
    exports = trees.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), "current_node", "mapping")).alias("json"))
    return I.chat_export(exports).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def src_vault_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    at = F.substring("id", 2, 20).cast("long")
    incoming = rows.where(at % 3 == 0).select(F.when(at % 2 == 0, F.concat(F.lit("f"), at)).otherwise(F.col("id")).alias("id"), F.when(at % 4 == 0, F.concat(F.lit("new "), "id")).otherwise(F.col("title")).alias("title"), F.when(at % 5 == 0, F.lit("other")).otherwise(F.col("content")).alias("content"))
    return I.import_vault(rows, incoming).groupBy("action").agg(F.count("*").alias("n"))


def src_merge_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).select("id", "title", "updated_at")
    at = F.substring("id", 2, 20).cast("long")
    incoming = rows.where(at % 2 == 0).select("id", F.lit("from backup").alias("title"), (F.col("updated_at") + (at % 3 - 1)).alias("updated_at"), F.lit(1).alias("pos"))
    again = incoming.where(F.col("id").endswith("4")).withColumns({"title": F.lit("last"), "pos": F.lit(2)})
    merged = I.merge_backup(rows, incoming.unionByName(again))
    replaced = I.merge_backup(rows, incoming.unionByName(again), replace=True)
    return merged.groupBy(F.when(F.col("title").isin("from backup", "last"), F.col("title")).otherwise("own").alias("title")).agg(F.count("*").alias("n")).crossJoin(replaced.agg(F.count("*").alias("replaced")))


def src_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).select("id", "title")
    return I.migrate(rows.where("id LIKE '%1'"), rows.where("id LIKE '%1' OR id LIKE '%2'").withColumn("title", F.lit("old"))).groupBy((F.col("title") == "old").alias("old")).agg(F.count("*").alias("n"))


def src_page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.page_notes(table(spark, sf_dir, "pages")).select("page_id", "title", F.length("content").alias("n"))


def src_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("id", F.posexplode(I.parts(F.col("content"))).alias("seq", "part")).groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("part")).alias("longest"))


def src_scan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = notes(spark, sf_dir).select(F.concat(F.lit("/home/u/"), "id", F.lit(".txt")).alias("path"), F.col("content").alias("text"))
    return I.scan_notes(files, notes(spark, sf_dir).withColumn("title", F.concat(F.substring("id", 1, 3), F.lit(".txt")))).groupBy("type").agg(F.count("*").alias("n"))


def src_longmem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("turns"))
    sessions = rows.select(F.concat(F.lit("q"), F.col("conv_id") % 5).alias("question_id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.lit("2023/05/20 (Sat) 02:21").alias("session_date"), "turns")
    return I.longmem_turns(sessions).select("id", "question_id", "session_id", "at", "role")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith(("sec_", "snk_", "src_", "str_"))}

_N = f"WITH {NOTES_SQL}"
_A = f"WITH {ACTIVITY_SQL}"


def _q(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"' END"""


_SEALED = f"""'["0",' || "at" || ',' || {_q('client')} || ',' || {_q('tool')} || ',' || {_q("CASE WHEN id % 3 > 0 THEN memory_id END")} || ',' || {_q('text')} || ']'"""
_CELL = lambda c: f"""CASE WHEN regexp_matches({c}, '[",\\n\\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
def _masked(c: str) -> str:
    """SEC-02 for keys of the lengths that ``sec_mask`` puts in."""
    for pattern, said in ((r"\bsk-ant-[A-Za-z0-9_-]{16,}\b", "sk-ant-…MASKIERT(27)"), (r"\bsk-[A-Za-z0-9]{16,}\b", "sk-"), (r"\bghp_[A-Za-z0-9]{16,}\b", "ghp_…MASKIERT(22)"), (r"\bxox[baprs]-[A-Za-z0-9-]{8,}\b", "xox"), (r"\bAKIA[0-9A-Z]{12,}\b", "AKIA")):
        c = f"regexp_replace({c}, '{pattern}', '{said}', 'g')"
    pattern = S.ASSIGNED.replace("'", "''")
    return f"regexp_replace({c}, '{pattern}', '\\1…MASKIERT(64)', 'g')"


_KEYED = "content || ' sk-ant-' || lpad(id, 20, 'a') || ' ghp_' || lpad(id, 18, 'b') || ' api_key: ' || sha256(id)"
_PLANTED = "content || ' write a' || id || '@mail.example.org, account DE' || lpad((doc_id % 98)::VARCHAR, 2, '0') || '500105170123' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || ', call +49 170 1234567 today'"


def _finds(text: str) -> str:
    """SEC-01 over the notes' ``text``: tables ``texts`` (id, t) and ``finds`` (id, kind, p, upto, value). The word edges of
    telephone numbers, which RE2 cannot look at without taking them, are part of the pattern here."""
    walk = lambda m: f"list_reduce(list_transform({m}, lambda v: [{{'p': 0, 'upto': 0, 'v': v}}]), lambda a, x: list_concat(a, [{{'p': a[-1].upto + strpos(substr(t, a[-1].upto + 1), x[1].v) - 1, 'upto': a[-1].upto + strpos(substr(t, a[-1].upto + 1), x[1].v) - 1 + len(x[1].v), 'v': x[1].v}}]), [{{'p': 0, 'upto': 0, 'v': ''}}])"
    email = "regexp_extract_all(t, '\\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){0,8}\\.[A-Za-z]{2,24}\\b')"
    iban = "regexp_extract_all(t, '\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b')"
    phone = "regexp_extract_all(t, '(?:^|[^\\p{L}\\p{N}_+])((?:\\+\\d{1,3}[ .-]?|0)\\(?\\d{1,5}\\)?(?:[ /.-]?\\d{2,6}){1,5})(?:$|[^\\p{L}\\p{N}_])', 1)"
    card = "regexp_extract_all(t, '\\b\\d(?:[ -]?\\d){12,18}\\b')"
    # RE2 repeats a thousand times at most
    keys = "regexp_extract_all(t, '" + S._SECRET_KEYS.replace("2000}", "1000}").replace("4000}", "1000}") + "')"
    named = "regexp_extract_all(t, '(?i)\\b(?:password|passwort|kennwort|passcode|pwd|pin|secret|token|api[ _-]?key|zugangscode)\\b[ \\t]*[:=][ \\t]*(\"[^\"\\n]{3,200}\"|''[^''\\n]{3,200}''|[^\\s,;]{3,200})', 1)"
    digits = "list_transform(string_split(reverse(regexp_replace(v, '[\\s-]', '', 'g')), ''), lambda c: c::INT)"
    luhn = f"list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0 AND len(list_distinct({digits})) > 1"
    spelled = "list_reduce(list_transform(string_split(substr(v, 5) || substr(v, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), lambda a, x: a || x)"
    return f"""texts AS (SELECT id, {text} AS t FROM notes),
hits AS ({" UNION ALL ".join(f"SELECT id, '{kind}' AS kind, {S.KINDS.index(kind)} AS rank, unnest({walk(found)}[2:]) AS h FROM texts" for kind, found in (("secret", keys), ("secret", named), ("iban", iban), ("card", card), ("email", email), ("phone", phone)))}),
sound AS (SELECT id, kind, rank, h.p AS p, h.upto AS upto, h.v AS v FROM hits),
checked AS (SELECT DISTINCT * FROM sound WHERE kind IN ('email', 'secret') OR (kind = 'card' AND {luhn}) OR (kind = 'iban' AND len(v) BETWEEN 15 AND 26 AND ({spelled})::HUGEINT % 97 = 1)
 OR (kind = 'phone' AND NOT regexp_full_match(trim(v), '\\d{{1,4}}[./-]\\d{{1,2}}[./-]\\d{{1,4}}') AND len(regexp_replace(v, '\\D', '', 'g')) BETWEEN 7 AND 15)),
finds AS (SELECT id, kind, p, upto, v AS value FROM checked c WHERE NOT EXISTS (SELECT 1 FROM checked d WHERE d.id = c.id AND (d.rank < c.rank OR (d.rank = c.rank AND d.upto - d.p > c.upto - c.p)) AND d.p < c.upto AND c.p < d.upto))"""


_TITLE_OF = lambda c: f"substr(trim(regexp_replace(coalesce(list_filter(string_split(coalesce({c}, ''), chr(10)), lambda x: trim(x) <> '')[1], ''), '^[#>*\\-\\s]+', '')), 1, 120)"
_YAML = lambda c: f"""CASE WHEN regexp_matches({c}, '[:#\\[\\]{{}},&*?|<>=!%@`"''\\n]|^[\\s-]|\\s$|^$') THEN '"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"' ELSE {c} END"""
_ISO = lambda c: f"strftime(make_timestamp_ms({c}), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(({c} % 1000)::VARCHAR, 3, '0') || 'Z'"

ORACLE = {
    "sec_mask": f"{_N}, m AS (SELECT id, {_KEYED} AS t FROM notes) SELECT id, len({_masked('t')}) AS n, md5({_masked('t')}) AS masked_md5, len(regexp_extract_all(t, '\\b(sk-ant-[A-Za-z0-9_-]{{16,}}|sk-[A-Za-z0-9]{{16,}}|ghp_[A-Za-z0-9]{{16,}}|xox[baprs]-[A-Za-z0-9-]{{8,}}|AKIA[0-9A-Z]{{12,}})\\b')) + 1 AS keys FROM m",
    "sec_pii": f"""{_N}, {_finds(_PLANTED)} SELECT id, kind, p AS start, upto AS "end", value FROM finds""",
    "sec_pseudonyms": f"""{_N}, {_finds("content || ' ask ann@x.org or b' || id || '@x.org, then ann@x.org'")},
n AS (SELECT id, kind, value, '[' || upper(kind) || '-' || row_number() OVER (PARTITION BY id, kind ORDER BY min(p)) || ']' AS name FROM finds GROUP BY id, kind, value),
g AS (SELECT id, p, upto, name, coalesce(lag(upto) OVER (PARTITION BY id ORDER BY p), 0) AS before FROM finds JOIN n USING (id, kind, value)),
j AS (SELECT id, string_agg(substr(t, before + 1, p - before) || name, '' ORDER BY p) AS head, max(upto) AS upto, count(DISTINCT name) AS names, any_value(t) AS t FROM g JOIN texts USING (id) GROUP BY id)
SELECT id, md5(head || substr(t, upto + 1)) AS text_md5, names FROM j""",
    "src_vault_plan": f"""{_N}, t AS (SELECT title, id AS m2, content AS c2 FROM notes QUALIFY row_number() OVER (PARTITION BY title ORDER BY updated_at DESC, id DESC) = 1),
i AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id ELSE id END AS id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || id ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE content END AS content FROM notes WHERE doc_id % 3 = 0),
j AS (SELECT coalesce(n.id, t.m2) AS m, CASE WHEN n.id IS NOT NULL THEN n.title || chr(10) || n.content ELSE t.title || chr(10) || t.c2 END = i.title || chr(10) || i.content AS same FROM i LEFT JOIN notes n ON n.id = i.id LEFT JOIN t ON t.title = i.title)
SELECT CASE WHEN m IS NULL THEN 'create' WHEN same THEN 'skip' ELSE 'update' END AS action, count(*) AS n FROM j GROUP BY 1""",
    "src_conversations_notes": f"""WITH s AS (SELECT * FROM conversations WHERE len(trim(text)) > 0), g AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**You:** ' ELSE '**Assistant:** ' END || substr(trim(text), 1, 12000), chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS turns, count(*) FILTER (WHERE role <> 'user') AS answers, arg_min(text, turn) FILTER (WHERE role = 'user') AS first FROM s GROUP BY conv_id)
SELECT conv_id, {_TITLE_OF('first')} AS title, turns, md5(content) AS content_md5 FROM g WHERE turns >= 2 AND answers >= 1""",
    "src_page_notes": f"SELECT page_id, trim(regexp_replace({_clean('t', 200)}, '[\\r\\n]+', ' ', 'g')) AS title, n FROM (SELECT page_id, replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&') AS t, len({_html_sql()}) AS n FROM pages)",
    "src_parts": f"{_N}, p AS (SELECT id, list_filter(list_transform(regexp_extract_all(content, '(?s).{{1000}}.{{100}}.{{0,900}}(?:\\n\\n|\\. )|.{{1,1000}}.{{0,1000}}'), lambda x: trim(x)), lambda x: x <> '') AS p FROM notes) SELECT id, len(p) AS n, list_max(list_transform(p, lambda x: len(x))) AS longest FROM p WHERE len(p) > 0",
    "src_scan_notes": f"""{_N}, files AS (SELECT id, id || '.txt' AS title, {_masked('content')} AS content, ['machine-scan', 'txt'] AS tags FROM notes WHERE id || '.txt' NOT IN (SELECT substr(id, 1, 3) || '.txt' FROM notes)),
{unusable_sql('files')}, good AS (SELECT files.* FROM files JOIN u USING (id) WHERE reason IS NULL), {type_sql('good')} SELECT CASE WHEN k[2] = 'plain text' THEN 'reference' ELSE k[1] END AS type, count(*) AS n FROM r GROUP BY 1""",
    "snk_markdown": f"""{_N}, f AS (SELECT *, CASE WHEN trim(nm) = '' THEN 'note' ELSE trim(nm) END AS name FROM (SELECT *, substr(trim(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80) AS nm FROM notes)),
m AS (SELECT id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS k, concat_ws(chr(10), '---', 'title: ' || {_YAML('title')}, 'tags: [' || array_to_string(list_transform(tags, lambda t: {_YAML('t')}), ', ') || ']', 'type: ' || type, CASE WHEN scope <> 'local' THEN 'scope: ' || {_YAML('scope')} END,
 CASE WHEN confidence < 1 THEN 'confidence: ' || printf('%.2f', confidence) END, 'created: ' || {_ISO('created_at')}, 'updated: ' || {_ISO('updated_at')}, 'valid_from: ' || {_ISO('valid_from')}, 'valid_to: ' || {_ISO('valid_to')}, 'note_id: ' || id, '---', '', content) AS text FROM f)
SELECT id, name || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS file, md5(text) AS text_md5 FROM m""",
    "sec_chain_verify": f"{_A} SELECT client AS actor, count(*) AS entries, CASE WHEN count(*) FILTER (WHERE id = 27) > 0 THEN 27 END AS broken_at FROM activity GROUP BY client",
    "sec_chain_heads": f"{_A} SELECT client AS actor, count(*) AS entries, NULL::BIGINT AS broken_at, client = 'client-5' AS truncated FROM activity GROUP BY client",
    "sec_seals": f"{_A} SELECT id, sha256({_SEALED}) AS hash FROM activity",
    "sec_private_blocks": f"{_N} SELECT id, 'a  b ' || title AS text FROM notes",
    "sec_urls": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id % 6 <> 4 ELSE false END AS blocked FROM pages",
    "sec_guard": f"{_N} SELECT id FROM notes WHERE scope <> 'private'",
    "sec_audit_rules": f"""{_A} SELECT id, CASE tool WHEN 'memory_search' THEN 'search' WHEN 'memory_save' THEN 'write' WHEN 'memory_list' THEN 'list' ELSE 'other' END AS action, memory_id || '; ' || client AS detail,
CASE id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' END AS route, CASE tool WHEN 'memory_search' THEN 'searched: ' || text WHEN 'memory_save' THEN 'saved: ' || text WHEN 'memory_list' THEN 'listed 3 notes' ELSE tool END AS line FROM activity""",
    "sec_roles": """WITH j AS (SELECT '{"default":"viewer","roles":{"ann":"admin","bo":"member","cy":"king"}}' AS j), k AS (SELECT j, unnest(json_keys(j, '$.roles')) AS actor FROM j), v AS (SELECT actor, json_extract_string(j, '$.roles.' || actor) AS role FROM k) SELECT actor, CASE WHEN role IN ('admin', 'member', 'viewer') THEN role ELSE 'viewer' END AS role FROM v""",
    "sec_bundle_round_trip": f"{_N} SELECT id, true AS same FROM notes WHERE scope = 'team:alpha' AND deleted_at IS NULL AND superseded_by IS NULL",
    "sec_readers": f"""{_A} SELECT client AS actor, count(*) AS n, max("at") AS last FROM activity WHERE contains(text, 'd7') OR memory_id = 'd7' GROUP BY client""",
    "str_clients": "SELECT ['Claude', 'ChatGPT', 'Cursor', 'my tool', 'Unknown app'][event_id % 5 + 1] AS who, count(*) AS n FROM events GROUP BY 1",
    "snk_csv": f"{_A}, r AS (SELECT id, CASE WHEN id % 5 = 0 THEN '''=' || client ELSE client END AS a, tool, text FROM activity) SELECT id, id || ',' || a || ',' || {_CELL('tool')} || ',' || {_CELL('text')} AS line FROM r",
    "snk_markdown_round_trip": f"{_N} SELECT true AS title, true AS content, true AS created, count(*) AS n FROM notes",
    "snk_bundle": f"{_N} SELECT id FROM notes WHERE scope = 'team:alpha' AND deleted_at IS NULL AND superseded_by IS NULL",
    "snk_page": f"""{_N}, p AS (SELECT id, regexp_replace(title, '[^A-Za-z ]', '', 'g') AS title, row_number() OVER (ORDER BY updated_at DESC, id) AS pos FROM notes WHERE deleted_at IS NULL QUALIFY pos <= 5),
b AS (SELECT '[' || string_agg('{{"id":"' || id || '","title":"' || title || '"}}', ',' ORDER BY pos) || ']' AS body FROM p), t AS (SELECT count(*) AS total FROM notes WHERE deleted_at IS NULL) SELECT body, sha1(body) AS etag, total, total > 5 AS limited FROM b, t""",
    "snk_backups": f"""{_N}, r AS (SELECT id AS name, updated_at AS "at", row_number() OVER (ORDER BY updated_at DESC, id DESC) AS r FROM notes) SELECT name, "at" FROM r WHERE r > 100""",
    "src_user_turns": "SELECT substr(sha1(conv_id || '#' || turn), 1, 16) AS id, conv_id, turn, md5(trim(text)) AS content_md5 FROM conversations WHERE role = 'user' AND len(trim(text)) >= 8",
    "src_chat_export": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant') AND len(trim(text)) > 0",
    "src_migrate": f"{_N} SELECT id LIKE '%2' AS old, count(*) AS n FROM notes WHERE id LIKE '%1' OR id LIKE '%2' GROUP BY 1",
    "src_merge_backup": f"{_N}, w AS (SELECT CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 2 THEN CASE WHEN id LIKE '%4' THEN 'last' ELSE 'from backup' END ELSE 'own' END AS title FROM notes) SELECT title, count(*) AS n, (SELECT count(*) FROM notes WHERE doc_id % 2 = 0) AS replaced FROM w GROUP BY title",
    "src_longmem": "SELECT substr(sha1('s' || conv_id || '#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)), 1, 16) AS id, 'q' || (conv_id % 5) AS question_id, 's' || conv_id AS session_id, 1684549260000 AS \"at\", role FROM conversations",
}
