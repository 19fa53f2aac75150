"""Registered queries of smaller operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import extensions as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import contradict as K
from ..operators import filters as L
from ..operators import graph as G
from ..operators import lifecycle as D
from ..operators import reports as R
from ..operators import search as S
from ..sources import imports as I
from ..sources.tables import CHUNKS_SQL, CLAIMS_SQL, CONCEPTS_SQL, NOTES_SQL, NOW_MS, PAIRS_SQL, active, chunks, claims, co_ordered, concept_mentions, notes, table, word_index
from ..store import scratch
from ..streaming import events as E
from .retrieval import BM25_SQL, TERMS, _strings
from .texts import C


def _n():
    return F.substring("id", 2, 20).cast("long")


def str_sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02 over pages with a handler and a script link put in."""
    html = X.sanitize_html(F.concat(F.lit("<a onclick='x()' href=\"JavaScript: go\">a</a><SCRIPT src=x>bad()</script>"), "html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(html).alias("n"), F.md5(html.cast("binary")).alias("html_md5"))


def str_part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21."""
    title = F.concat("title", F.when(_n() % 3 == 0, F.concat(F.lit(" — Teil "), _n() % 5 + 1, F.lit("/5"))).when(_n() % 3 == 1, F.concat(F.lit(" — "), _n() % 7, F.lit("/12"))).otherwise(""))
    s = X.part_of_title(title)
    return notes(spark, sf_dir).select("id", s["base"].alias("base"), s["part"].alias("part"), s["parts"].alias("parts"))


def ret_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04: the hits of two questions, each note where it first comes."""
    index, rows = word_index(spark, sf_dir), notes(spark, sf_dir)
    lists = None
    for number, terms in enumerate((TERMS, ["apache", "license"])):
        top = S.bm25(rows, terms, index=index).orderBy(F.desc(F.round("bm25", 9)), "id").limit(20)
        one = top.select(F.lit(number).alias("list"), F.row_number().over(Window.orderBy(F.desc(F.round("bm25", 9)), "id")).alias("rank"), "id")
        lists = one if lists is None else lists.unionAll(one)
    return S.first_wins(lists)


def ret_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, RET-18: the best hits that fit in a prompt, as blocks."""
    rows = notes(spark, sf_dir)
    top = S.bm25(rows, TERMS, index=word_index(spark, sf_dir)).orderBy(F.desc(F.round("bm25", 9)), "id").limit(60)
    ranked = top.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("bm25", 9)), "id")).alias("rank")).join(rows, "id")
    packed = S.pack(ranked.select("rank", "id", X.token_estimate(F.col("content")).alias("tokens")), 6000)
    block = S.prompt_block(F.col("id"), F.col("title"), F.col("tags"), F.col("content"))
    return packed.join(rows, "id").select("pos", "id", "used", F.md5(block.cast("binary")).alias("block_md5"))


def ret_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-19: whether a note's last 40 characters, or an abstention, stand in it."""
    answer = F.when(_n() % 9 == 0, "I don't know").when(_n() % 9 == 1, F.concat(F.lit("not there "), "id")).otherwise(F.substring("content", -40, 40))
    return notes(spark, sf_dir).select("id", S.verbatim_hit(answer, F.col("content")).alias("hit"))


def ret_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-19, RET-20: points of verdicts, by scope."""
    verdict = F.when(_n() % 3 == 0, "Yes, it says so.").when(_n() % 3 == 1, "**Partly** right").otherwise("No.")
    return notes(spark, sf_dir).groupBy("scope").agg(F.sum(S.judged(verdict, _n() % 4 == 0)).alias("points"))


def gra_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-23: real pairs and similar notes."""
    real = co_ordered(spark, sf_dir).select("source", "target").distinct().select(F.lit(True).alias("real"))
    similar = active(notes(spark, sf_dir)).where(F.col("superseded_by").isNotNull()).select(F.lit(False).alias("real"))
    return G.tally(real.unionAll(similar))


def agg_graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05."""
    entities = concept_mentions(spark, sf_dir).select("concept").distinct()
    return G.totals(entities, claims(spark, sf_dir))


def agg_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    tags = F.when(_n() % 7 == 0, F.array(F.lit("machine-scan"))).when(_n() % 5 == 0, F.array(F.lit("Obsidian"), F.lit("x"))).otherwise(F.col("tags"))
    return R.provenance_picture(notes(spark, sf_dir).withColumn("tags", tags))


def agg_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: conversations as questions of three kinds, their turns as sessions, answers marked."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("sessions"), F.collect_list(F.when(F.col("role") != "user", F.col("turn"))).alias("answers"))
    return I.dataset_distribution(rows.select(F.concat(F.lit("kind"), F.col("conv_id") % 3).alias("question_type"), "sessions", "answers"))


def dml_write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-15."""
    rows = notes(spark, sf_dir)
    near = rows.where(_n() % 2 == 0).select("id", F.concat(F.lit("d"), _n() + 1).alias("other"), (F.lit(0.9) + (_n() % 10) / 100).alias("cosine"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("update", "delete", "noop", "add", "odd")]), (_n() % 5 + 1).cast("int"))
    return D.write_gate(rows.select("id"), near, said).groupBy("decision").agg(F.count("*").alias("n"))


def flt_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, UDF-01: what one actor may read."""
    rows = notes(spark, sf_dir).withColumn("owner", F.element_at("tags", 2))
    return P.Extensions(policy=P.ScopePolicy(), actor="src3").filtered(rows).select("id")


def src_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24."""
    return K.comparable(notes(spark, sf_dir), 20_000).select("id", "updated_at")


def arr_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-01: vectors written as bytes and read back."""
    rows = chunks(spark, sf_dir).select("memory_id", V.to_blob("embedding").alias("blob"))
    back = V.of_blob(F.concat("blob", F.lit(b"xy")))
    return rows.select("memory_id", F.length("blob").alias("bytes"), F.hex(F.expr("substring(blob, 1, 4)")).alias("first"), back.alias("v")).select("memory_id", "bytes", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def cls_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-08: the four ways to group a list."""
    line = F.when(_n() % 4 == 0, F.concat(F.lit("\n— Source: /home/u/f"), _n() % 9, F.lit(".md"))).when(_n() % 4 == 1, "\n— Source: https://example.org/a").when(_n() % 4 == 2, "\n— Source: inbox scan.txt").otherwise("")
    rows = active(notes(spark, sf_dir)).withColumn("content", F.concat("content", line))
    out = None
    for mode in ("file", "topic", "type", "period"):
        one = L.list_groups(rows, mode, 1704067200000 + 30 * 86_400_000).groupBy("key").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "key", "n")
        out = one if out is None else out.unionAll(one)
    return out


def srt_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: words with accents and capitals in the order of a dictionary."""
    word = F.lower(F.regexp_extract("title", "([A-Za-z]{3,})", 1))
    said = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a", "ä", "A", "z")]), (_n() % 4 + 1).cast("int")), word)
    rows = notes(spark, sf_dir).select("id", said.alias("word"))
    return rows.orderBy(L.locale_order(F.col("word")), "id").limit(200).withColumn("word", F.col("word").cast("string"))


def stm_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: each file lies in the folder twice, in two batches; its parts become notes once."""
    at = scratch(spark, "stream-inbox")
    rows = notes(spark, sf_dir).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(_n() % 10 == 3, 30_000_000).otherwise(F.octet_length("content")).cast("long").alias("size"), F.col("content").alias("text"))
    for _ in range(2):  # the second time the stream goes on where it stopped, with batches of its own
        rows.write.mode("append").parquet(f"{at}/in")
        E.inbox(E.file_stream(spark, rows.schema, f"{at}/in", 1000), f"{at}/out", f"{at}/check")
    made = spark.read.option("recursiveFileLookup", True).parquet(f"{at}/out")
    return made.groupBy(F.regexp_replace("title", r" — Teil .*$", "").alias("file")).agg(F.count("*").alias("parts"), F.sum(F.length("content")).alias("n"), F.min("title").alias("first"))


def stm_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08: texts in pieces of seven characters, their place holders put back."""
    at = scratch(spark, "stream-restored")
    text = F.concat(F.lit("call [PHONE-1] or [EMAIL-1] on ["), "title", F.lit("] [EMAIL-2] ["))
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,7}"), F.lit(0))
    rows = notes(spark, sf_dir).select(F.col("id").alias("key"), F.size(cut).alias("k"), F.posexplode(cut).alias("n", "piece"))
    rows = rows.select("key", F.col("n").cast("long").alias("n"), "piece", (F.col("n") == F.col("k") - 1).alias("last"))
    rows.write.parquet(f"{at}/in")  # all pieces of a text are in one file
    done = E.restored(E.file_stream(spark, rows.schema, f"{at}/in", 1000), {"[PHONE-1]": "+49 1", "[EMAIL-1]": "ann@x.org"})
    query = done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    back = spark.read.schema(done.schema).parquet(f"{at}/out")
    return back.groupBy("key").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").cast("binary")).alias("text_md5"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name.startswith(("str_", "ret_", "gra_", "agg_", "dml_", "flt_", "src_", "arr_", "cls_", "srt_", "stm_"))}

_N = f"WITH {NOTES_SQL}"
_L = f"WITH {NOTES_SQL}, live AS (SELECT * FROM notes WHERE deleted_at IS NULL)"
_BM = f"{_N}, {BM25_SQL}"
_BM2 = BM25_SQL.replace(_strings(TERMS), _strings(["apache", "license"]))
_TOP = "SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm QUALIFY rank <= {n}"
_FLAT = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_CLEAN = "regexp_replace(substr(regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 1, 50000), '^\\s+|\\s+$', '', 'g')"
_HTML = _CLEAN.format(c="'<a onclick=''x()'' href=\"JavaScript: go\">a</a><SCRIPT src=x>bad()</script>' || html")
_WORD = "['a', 'ä', 'A', 'z'][doc_id % 4 + 1] || lower(regexp_extract(title, '([A-Za-z]{3,})', 1))"
_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title || chr(10) || content, '(?i)\\b({w})\\b') THEN '{k}' END" for k, w in C.TOPICS.items()) + "], lambda x: x IS NOT NULL)"
_LINE = "CASE doc_id % 4 WHEN 0 THEN chr(10) || '— Source: /home/u/f' || (doc_id % 9) || '.md' WHEN 1 THEN chr(10) || '— Source: https://example.org/a' WHEN 2 THEN chr(10) || '— Source: inbox scan.txt' ELSE '' END"
_NOW = 1704067200000 + 30 * 86_400_000

ORACLE = {
    "str_sanitize_html": f"SELECT page_id, len(h) AS n, md5(h) AS html_md5 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?is)<script.*?>.*?</script>', '', 'g'), '(?i)on\\w+\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', '', 'g'), '(?i)javascript:\\s*', '', 'g') AS h FROM pages)",
    "str_part_titles": f"{_N} SELECT id, CASE WHEN doc_id % 3 < 2 THEN regexp_replace(title, '\\s+$', '') ELSE title END AS base, CASE doc_id % 3 WHEN 0 THEN doc_id % 5 + 1 WHEN 1 THEN doc_id % 7 ELSE 0 END AS part, CASE doc_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 12 ELSE 0 END AS parts FROM notes",
    "ret_first_wins": f"WITH a AS ({_BM} {_TOP.format(n=20)}), b AS ({_N}, {_BM2} {_TOP.format(n=20)}) SELECT 0 AS list, rank, id FROM a UNION ALL SELECT 1, rank, id FROM b WHERE id NOT IN (SELECT id FROM a)",
    "ret_context": f"""WITH RECURSIVE t AS ({_BM} {_TOP.format(n=60)}), {NOTES_SQL}, h AS MATERIALIZED (SELECT t.rank, id, ceil(len(content) / 3.5)::BIGINT AS tokens FROM t JOIN notes USING (id)),
f AS (SELECT 0::BIGINT AS rank, 0::BIGINT AS used, []::VARCHAR[] AS ids UNION ALL SELECT h.rank, CASE WHEN len(ids) = 0 OR (used + tokens <= 6000 AND len(ids) < 24) THEN used + tokens ELSE used END, CASE WHEN len(ids) = 0 OR (used + tokens <= 6000 AND len(ids) < 24) THEN list_append(ids, id) ELSE ids END FROM f JOIN h ON h.rank = f.rank + 1),
p AS (SELECT used, ids FROM f ORDER BY rank DESC LIMIT 1), e AS (SELECT used, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM p)
SELECT pos, id, used, md5('[ID: ' || id || ' | TAGS: ' || array_to_string(tags, ', ') || ' | TITEL: ' || title || ']' || chr(10) || content) AS block_md5 FROM e JOIN notes USING (id)""",
    "ret_verbatim": f"{_N}, a AS (SELECT id, doc_id, {_FLAT('content')} AS c, {_FLAT('right(content, 40)')} AS w FROM notes) SELECT id, CASE doc_id % 9 WHEN 0 THEN false WHEN 1 THEN contains(c, 'not there ' || id) ELSE w <> '' AND contains(c, w) END AS hit FROM a",
    "ret_judged": f"{_N}, p AS (SELECT scope, doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END AS p FROM notes) SELECT scope, sum(CASE WHEN doc_id % 4 = 0 THEN 1 - p ELSE p END) AS points FROM p GROUP BY scope",
    "gra_tally": f"{_N}, {PAIRS_SQL} SELECT (SELECT count(*) FROM (SELECT DISTINCT source, target FROM pairs)) AS real, count(*) AS similar FROM notes WHERE deleted_at IS NULL AND superseded_by IS NOT NULL",
    "agg_graph_totals": f"WITH {CONCEPTS_SQL}, {CLAIMS_SQL} SELECT (SELECT count(DISTINCT concept) FROM cm) AS nodes, count(*) AS edges FROM claims",
    "agg_provenance": f"{_N} SELECT CASE WHEN doc_id % 7 = 0 THEN 'machine' WHEN doc_id % 5 = 0 THEN 'file' ELSE 'written' END AS provenance, count(*) AS n, true AS available FROM notes GROUP BY 1",
    "agg_dataset": "SELECT 'kind' || (conv_id % 3) AS question_type, count(DISTINCT conv_id) AS questions, count(*) AS sessions, count(DISTINCT CASE WHEN role <> 'user' THEN conv_id END) AS marked FROM conversations GROUP BY 1",
    "dml_write_gate": f"{_N} SELECT CASE WHEN doc_id % 2 = 0 AND 0.9::DOUBLE + (doc_id % 10) / 100 >= 0.92::DOUBLE THEN ['UPDATE', 'DELETE', 'NOOP', 'ADD', 'ADD'][doc_id % 5 + 1] ELSE 'ADD' END AS decision, count(*) AS n FROM notes GROUP BY 1",
    "flt_policy": f"{_N} SELECT id FROM notes WHERE scope <> 'private' OR tags[2] = 'src3'",
    "src_comparable": f"{_N} SELECT id, updated_at FROM notes WHERE deleted_at IS NULL AND superseded_by IS NULL AND type IN ('semantic', 'procedural') AND NOT regexp_matches(title, '\\s[—–-]\\s\\d+/([2-9]|\\d{{2,}})$') ORDER BY updated_at DESC, id LIMIT 20000",
    "arr_blob": f"WITH {CHUNKS_SQL} SELECT memory_id, 4 * len(embedding) AS bytes, len(embedding) AS n, round(list_sum(embedding), 6) AS total FROM chunks",
    "cls_groups": f"""{_L}, k AS (SELECT doc_id, type, created_at, {_TOPICS.replace('content', "(content || " + _LINE + ")")} AS t FROM live)
SELECT 'file' AS mode, CASE doc_id % 4 WHEN 0 THEN 'file:/home/u/f' || (doc_id % 9) || '.md' WHEN 1 THEN 'url:https://example.org/a' WHEN 2 THEN 'inbox:scan.txt' ELSE 'none' END AS key, count(*) AS n FROM k GROUP BY ALL
UNION ALL SELECT 'topic', key, count(*) FROM (SELECT unnest(CASE WHEN len(t) = 0 THEN ['no topic'] ELSE t END) AS key FROM k) GROUP BY key
UNION ALL SELECT 'type', 'type:' || type, count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'period', CASE WHEN created_at >= {_NOW - _NOW % 86_400_000} THEN 'today' WHEN created_at >= {_NOW - _NOW % 86_400_000 - 6 * 86_400_000} THEN 'this week' ELSE 'older' END, count(*) FROM k GROUP BY ALL""",
    "srt_locale": f"{_N}, w AS (SELECT id, {_WORD} AS word FROM notes) SELECT id, word FROM w ORDER BY strip_accents(lower(word)), word LIKE 'ä%', word LIKE 'A%', id LIMIT 200",
    "stm_inbox": f"""{_N}, p AS (SELECT id, list_filter(list_transform(regexp_extract_all(substr(content, 1, 50000), '(?s).{{1000}}.{{100}}.{{0,900}}(?:\\n\\n|\\. )|.{{1,1000}}.{{0,1000}}'), lambda x: trim(x)), lambda x: x <> '') AS p FROM notes WHERE doc_id % 10 <> 3 AND trim(content) <> '')
SELECT id AS file, len(p) AS parts, list_sum(list_transform(p, lambda x: len({_CLEAN.format(c='x')}) + len(id) + 22))::BIGINT AS n, CASE WHEN len(p) = 1 THEN id ELSE list_min(list_transform(range(1, len(p) + 1), lambda i: id || ' — Teil ' || i || '/' || len(p))) END AS first FROM p WHERE len(p) > 0""",
    "stm_restored": f"{_N} SELECT id AS key, md5('call +49 1 or ann@x.org on [' || title || '] [EMAIL-2] [') AS text_md5 FROM notes",
}
