"""Registered retrieval queries and their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..operators.batchsearch import bm25_top
from ..sources.tables import CHUNKS_SQL, MENTIONS_SQL, NOTES_SQL, NOW_MS, active, chunks, mentions, notes, table, weight_index, word_index
from ..store import written

QUERY = "red widget apache license ertion"
ALL = frozenset({"bm25", "vector", "entity"})


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of vector 0 stands for the query's."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TERMS = S.content_terms(QUERY)
_STOP = _strings(X.STOPWORDS)

TOKENS_SQL = f"""
tok AS (
  SELECT id, deleted_at, list_filter(regexp_split_to_array(translate(lower(concat_ws(' ', title, content, array_to_string(tags, ' '))), '{X.ACCENTED}', '{X.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS toks
  FROM notes)"""

BM25_SQL = (
    TOKENS_SQL
    + f""",
q AS (SELECT unnest({_strings(TERMS)}) AS term),
tf AS (SELECT id, deleted_at, len(toks) AS length, term, len(list_filter(toks, lambda t: t = term)) AS tf FROM tok, q),
stat AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM tok),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm AS (
  SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * ((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (length / al))))) AS bm25, count(*) AS matched
  FROM tf JOIN df USING (term), stat WHERE tf > 0 AND deleted_at IS NULL GROUP BY id)"""
)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.bm25(notes(spark, sf_dir), TERMS, index=word_index(spark, sf_dir)).orderBy(F.desc(F.round("bm25", 9)), "id").limit(20), "bm25")


def and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.bm25_and_or(notes(spark, sf_dir), ["apache", "license"], 5, index=word_index(spark, sf_dir)), "bm25")


def vector_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = active(notes(spark, sf_dir))
    return S.vector_leg(chunks(spark, sf_dir), query_vector(spark, sf_dir), "m0", live).select("id", F.round("similarity", 6).alias("similarity"))


def entity_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.entity_leg(mentions(spark, sf_dir), QUERY)


def _search(spark: SparkSession, sf_dir: str, **asked) -> DataFrame:
    s = S.Search(query=asked.pop("query", QUERY), now_ms=NOW_MS, **asked)
    found = S.search(notes(spark, sf_dir), s, chunks=chunks(spark, sf_dir), query_vector=query_vector(spark, sf_dir), mentions=mentions(spark, sf_dir), index=word_index(spark, sf_dir))
    return _rounded(found, "score", "rerank").withColumn("similarity", F.round("similarity", 6)).withColumn("matched_terms", F.array_join("matched_terms", " "))


def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, limit=25)


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, limit=25, as_of=1705000000000)


def filtered_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, limit=10, offset=5, tags=("en",), scope="local", valid_since=1704500000000)


def recency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(notes(spark, sf_dir), S.Search(query="", now_ms=NOW_MS, limit=30))
    return found.select("id", "updated_at", "total", "expired", "superseded")


def only_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, limit=25, legs=frozenset({"bm25"}))


_ENDING = "'(ung|en|er|es|em|e|s|n)$'"


def _rerank_sql(query: str) -> tuple[str, str, str, str]:
    """RET-08: the score over ``intitle``, ``intext`` and ``tagst``, and the SQL of these three lists."""
    words = S.words_of(query)
    cover, title_cover, tag = [], [], []
    for w in words:
        st = re.sub("(ung|en|er|es|em|e|s|n)$", "", w)
        loose = f"WHEN len(list_filter(intext, lambda d: starts_with(d, '{st}') OR starts_with('{st}', d))) > 0 THEN 0.6::DOUBLE" if len(st) >= 4 else ""
        cover.append(f"CASE WHEN list_contains(intext, '{st}') THEN 1::DOUBLE {loose} ELSE 0::DOUBLE END")
        title_cover.append(f"CASE WHEN list_contains(intitle, '{st}') THEN 1::DOUBLE ELSE 0::DOUBLE END")
        tag.append(f"list_contains(tagst, '{st}')")
    q = query.lower()
    stems = lambda c: f"list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: regexp_replace(w, {_ENDING}, ''))"
    score = f"""greatest(0, least(1, ({" + ".join(cover)}) / {len(words)} * 0.6 + least(({" + ".join(title_cover)}) / {len(words)}, 1) * 0.2
         + CASE WHEN contains(lower(content), '{q}') THEN 0.15 ELSE 0 END + CASE WHEN contains(lower(title), '{q}') THEN 0.25 ELSE 0 END + CASE WHEN {" OR ".join(tag)} THEN 0.1 ELSE 0 END))::DOUBLE"""
    return score, stems("title"), f"list_concat({stems('content')}, {stems('title')})", f"list_transform(tags, lambda t: regexp_replace(lower(t), {_ENDING}, ''))"


def search_sql(filters: str = "true", limit: int = 10, offset: int = 0, as_of_ms: int | None = None, legs: frozenset[str] = ALL, query: str = QUERY) -> str:
    now = NOW_MS if as_of_ms is None else as_of_ms
    expired = "false" if as_of_ms is not None else f"coalesce(valid_to < {now}, false)"
    said = S.expand_query(query)
    words, asked = S.words_of(said), S.content_terms(said)
    bm25 = BM25_SQL.replace(_strings(TERMS), _strings(asked))
    pieces = _strings(S.query_pieces(said))
    parts = ["SELECT id, 'bm25' AS leg, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM bmd"]
    others = "SELECT id FROM bmd"
    if "entity" in legs:
        parts.append("SELECT id, 'entity', row_number() OVER (ORDER BY id) FROM ent")
        others += " UNION ALL SELECT id FROM ent"
    if "vector" in legs:
        parts.append("SELECT id, 'vector', row_number() OVER (ORDER BY similarity DESC, id) FROM band")
    rerank, in_title, in_text, of_tags = _rerank_sql(said)
    terms = " || ".join(f"CASE WHEN contains(lower(title), '{w}') OR contains(lower(content), '{w}') THEN '{w} ' ELSE '' END" for w in words)
    return f"""
WITH {NOTES_SQL}, {CHUNKS_SQL}, {MENTIONS_SQL}, {bm25},
fullm AS (SELECT count(*) AS full_ FROM bm WHERE matched = {len(asked)}),
bmd AS (SELECT id, bm25 FROM bm, fullm WHERE full_ < {max(500, 2 * (offset + limit))} OR matched = {len(asked)} ORDER BY bm25 DESC, id LIMIT {max(500, 2 * (offset + limit))}),
ent AS (SELECT DISTINCT memory_id AS id FROM mentions WHERE list_contains({pieces}, entity) AND memory_id IN (SELECT id FROM notes WHERE deleted_at IS NULL)),
qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
vs AS (SELECT memory_id AS id, max(list_cosine_similarity(embedding, v)) AS similarity FROM chunks, qv WHERE model = 'm0' AND memory_id IN (SELECT id FROM notes WHERE deleted_at IS NULL) GROUP BY 1),
vt AS (SELECT greatest(0, max(similarity)) AS top FROM vs),
band AS (SELECT id, similarity FROM vs, vt WHERE similarity >= CASE WHEN top > 0 THEN least(top, greatest(0.58, top * 0.86)) ELSE 0.58 END),
legs AS ({" UNION ALL ".join(parts)}),
wt AS (SELECT CASE WHEN (SELECT count(*) FROM ({others})) = 0 OR (SELECT top FROM vt) >= 0.58 THEN 1::DOUBLE ELSE 0::DOUBLE END AS vw),
fused AS (
  SELECT id, sum(CASE WHEN leg = 'vector' THEN vw ELSE 1::DOUBLE END / (60 + rank)) AS rrf,
         min(CASE WHEN leg = 'bm25' THEN rank END) AS bm25_rank, min(CASE WHEN leg = 'vector' THEN rank END) AS vector_rank, min(CASE WHEN leg = 'entity' THEN rank END) AS entity_rank
  FROM legs, wt GROUP BY id),
st AS (
  SELECT f.*, n.* EXCLUDE (id), {in_title} AS intitle, {in_text} AS intext, {of_tags} AS tagst
  FROM fused f JOIN notes n USING (id) WHERE deleted_at IS NULL),
rr AS (
  SELECT *, {rerank} AS rerank
  FROM st),
hit AS (
  SELECT id, title, content, updated_at, bm25_rank, vector_rank, entity_rank, rerank, {expired} AS expired, superseded_by IS NOT NULL AS superseded,
         rrf * (1 + greatest(0::DOUBLE, 1 - greatest(0, {now} - updated_at) / (365 * 86400000.0::DOUBLE)) * 0.15::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * confidence)
         * (0.2::DOUBLE + 0.8::DOUBLE * exp(-coalesce(({now} - last_access_at) / 86400000.0::DOUBLE, 0) / ((utility + least(access_count, 10) + 0.1::DOUBLE) * 90)))
         * CASE WHEN {expired} THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN superseded_by IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END * (1 + rerank * 0.25::DOUBLE) AS score
  FROM rr WHERE {filters})
SELECT id, title, round(score, 9) AS score, bm25_rank, vector_rank, entity_rank,
       {"(SELECT round(similarity, 6) FROM band WHERE band.id = hit.id)" if "vector" in legs else "NULL::DOUBLE"} AS similarity,
       round(rerank, 9) AS rerank, expired, superseded, updated_at, (SELECT count(*) FROM hit) AS total, rtrim({terms}) AS matched_terms
FROM hit ORDER BY hit.score DESC, hit.updated_at DESC, id LIMIT {limit} OFFSET {offset}
"""


def tfidf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.hybrid(active(notes(spark, sf_dir)), QUERY, top_k=20, index=weight_index(spark, sf_dir)), "score", "cosine", "bm25")


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.naive(notes(spark, sf_dir), "ertion thonand en")


def dense_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-13."""
    live = active(notes(spark, sf_dir))
    dense = S.vector_leg(chunks(spark, sf_dir), query_vector(spark, sf_dir), "m0", live).select("id", F.col("similarity").alias("cosine"))
    return _rounded(S.hybrid(live, QUERY, top_k=20, dense=dense, index=weight_index(spark, sf_dir)), "score", "cosine", "bm25")


def rerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(S.rerank("apache license en", F.col("title"), F.col("content"), F.col("tags")), 9)
    # a generator, not a projection: else the filter would make the score again
    return active(notes(spark, sf_dir)).select("id", F.explode(F.array(score)).alias("rerank")).where("rerank > 0.15")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24 over two sets of legs. Queries are the titles of the live notes whose number 50 divides; the note itself is
    what should be found, and those that carry a concept of that name come as the second leg."""
    from pyspark.sql import Window

    rows = active(notes(spark, sf_dir)).select("id", "title")
    number = F.substring("id", 2, 20).cast("long")
    asked = rows.where((number % 50 == 0) & (F.length("title") > 20)).select(F.col("id").alias("query_id"), X.content_terms(F.col("title")).alias("terms"))
    relevant = asked.select("query_id", F.col("query_id").alias("id"), F.lit("lexical").alias("category"))
    found = bm25_top(word_index(spark, sf_dir), asked, 500)
    w = Window.partitionBy("query_id")
    words = written(found).select("query_id", "id", F.row_number().over(w.orderBy(F.desc(F.round("bm25", 9)), "id")).alias("rank")).where("rank <= 500")
    live = rows.select("id")
    asked_words = written(asked.select("query_id", F.explode("terms").alias("word")))
    named = asked_words.join(mentions(spark, sf_dir, asked_words.select("word").distinct()).select(F.col("memory_id").alias("id"), F.explode(F.array_distinct(F.split("entity", " "))).alias("word")), "word")
    named = named.join(live, "id", "left_semi").select("query_id", "id").distinct()
    concepts = named.select("query_id", "id", F.row_number().over(w.orderBy("id")).alias("rank"))
    both = words.unionAll(concepts).groupBy("query_id", "id").agg(F.sum(1 / (60 + F.col("rank"))).alias("rrf"))
    fused = both.select("query_id", "id", F.row_number().over(w.orderBy(F.desc(F.round("rrf", 9)), "id")).alias("rank"))
    out = None
    for name, hits in (("words", words), ("words+concepts", fused)):
        measured = S.metrics(hits, relevant).select(F.lit(name).alias("legs"), "category", *[F.round(c, 9).alias(c) for c in ("hit_at_1", "recall_at_5", "precision_at_5", "mrr")], "queries")
        out = measured if out is None else out.unionAll(measured)
    return out


QUERIES = {
    "ret_bm25_topk": bm25_topk, "ret_and_or": and_or, "ret_vector_band": vector_band, "ret_entity_leg": entity_leg, "ret_boosted_search": boosted,
    "ret_asof_search": as_of, "ret_filtered_paged": filtered_paged, "ret_recency_list": recency_list, "ret_word_leg_only": only_words, "ret_tfidf_hybrid": tfidf_hybrid,
    "ret_dense_hybrid": dense_hybrid, "ret_naive_baseline": naive, "ret_rerank": rerank_all, "ret_ablation_metrics": ablation,
}

def _ablation_sql() -> str:
    from .texts import terms_sql

    fold = f"list_distinct(list_transform(terms, lambda t: translate(lower(t), '{X.ACCENTED}', '{X.PLAIN}')))"
    measures = lambda name, hits: f"""SELECT '{name}' AS legs, category, round(avg(CASE WHEN first = 1 THEN 1 ELSE 0 END), 9)::DOUBLE AS hit_at_1, round(avg(found), 9)::DOUBLE AS recall_at_5, round(avg(found / 5), 9)::DOUBLE AS precision_at_5, round(avg(coalesce(1 / first, 0)), 9)::DOUBLE AS mrr, count(*) AS queries
FROM (SELECT a.query_id, 'lexical' AS category, count(CASE WHEN rank <= 5 THEN 1 END) AS found, min(rank) AS first FROM asked a LEFT JOIN {hits} h ON h.query_id = a.query_id AND h.id = a.query_id GROUP BY a.query_id) GROUP BY category"""  # noqa: E731
    return f"""WITH {NOTES_SQL}, {MENTIONS_SQL}, {TOKENS_SQL}, stat AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM tok),
tf AS (SELECT id, deleted_at, length, term, count(*) AS tf FROM (SELECT id, deleted_at, len(toks) AS length, unnest(toks) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT id AS query_id, {terms_sql('title')} AS terms FROM notes WHERE deleted_at IS NULL AND doc_id % 50 = 0 AND len(title) > 20), qx AS (SELECT query_id, unnest({fold}) AS term FROM asked),
sc AS (SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * ((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (length / al))))) AS s FROM qx JOIN tf USING (term) JOIN df USING (term), stat WHERE deleted_at IS NULL GROUP BY ALL),
words AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 500),
named AS (SELECT DISTINCT query_id, memory_id AS id FROM (SELECT query_id, unnest(terms) AS word FROM asked) JOIN (SELECT memory_id, unnest(string_split(entity, ' ')) AS word FROM mentions) USING (word) WHERE memory_id IN (SELECT id FROM notes WHERE deleted_at IS NULL)),
concepts AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM named),
both_ AS (SELECT query_id, id, sum(1 / (60 + rank)) AS rrf FROM (SELECT * FROM words UNION ALL SELECT * FROM concepts) GROUP BY ALL),
fused AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM both_)
{measures('words', 'words')} UNION ALL {measures('words+concepts', 'fused')}"""


_RERANK = _rerank_sql("apache license en")
ORACLE = {
    "ret_ablation_metrics": _ablation_sql(),
    "ret_rerank": f"WITH {NOTES_SQL}, st AS (SELECT *, {_RERANK[1]} AS intitle, {_RERANK[2]} AS intext, {_RERANK[3]} AS tagst FROM notes WHERE deleted_at IS NULL), rr AS (SELECT id, round({_RERANK[0]}, 9) AS rerank FROM st) SELECT * FROM rr WHERE rerank > 0.15",
    "ret_bm25_topk": f"WITH {NOTES_SQL}, {BM25_SQL} SELECT id, round(bm25, 9) AS bm25, matched FROM bm ORDER BY round(bm25, 9) DESC, id LIMIT 20",
    "ret_and_or": f"WITH {NOTES_SQL}, {BM25_SQL.replace(_strings(TERMS), _strings(['apache', 'license']))}, f AS (SELECT count(*) AS c FROM bm WHERE matched = 2) SELECT id, round(bm25, 9) AS bm25, matched FROM bm, f WHERE c < 5 OR matched = 2 ORDER BY bm.bm25 DESC, id LIMIT 5",
    "ret_vector_band": f"""WITH {NOTES_SQL}, {CHUNKS_SQL}, qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT memory_id AS id, max(list_cosine_similarity(embedding, v)) AS similarity FROM chunks, qv WHERE model = 'm0' AND memory_id IN (SELECT id FROM notes WHERE deleted_at IS NULL) GROUP BY 1),
t AS (SELECT greatest(0, max(similarity)) AS top FROM s)
SELECT id, round(similarity, 6) AS similarity FROM s, t WHERE similarity >= CASE WHEN top > 0 THEN least(top, greatest(0.58, top * 0.86)) ELSE 0.58 END""",
    "ret_entity_leg": f"WITH {MENTIONS_SQL} SELECT DISTINCT memory_id AS id FROM mentions WHERE list_contains({_strings(S.query_pieces(QUERY))}, entity)",
    "ret_boosted_search": search_sql(limit=25),
    "ret_asof_search": search_sql("coalesce(valid_from, created_at) <= 1705000000000 AND (valid_to IS NULL OR valid_to > 1705000000000)", 25, 0, 1705000000000),
    "ret_filtered_paged": search_sql("list_contains(tags, 'en') AND scope = 'local' AND (valid_from IS NULL OR valid_from >= 1704500000000)", 10, 5),
    "ret_word_leg_only": search_sql(limit=25, legs=frozenset({"bm25"})),
    "ret_recency_list": f"WITH {NOTES_SQL} SELECT id, updated_at, (SELECT count(*) FROM notes WHERE deleted_at IS NULL) AS total, coalesce(valid_to < {NOW_MS}, false) AS expired, superseded_by IS NOT NULL AS superseded FROM notes WHERE deleted_at IS NULL ORDER BY updated_at DESC, id LIMIT 30",
    "ret_naive_baseline": f"""WITH {NOTES_SQL} SELECT * FROM (SELECT id, CASE WHEN contains(lower(title), 'ertion thonand en') THEN 10 ELSE 0 END + CASE WHEN contains(lower(title), 'ertion thonand en') OR contains(lower(content), 'ertion thonand en') THEN 5 ELSE 0 END
{"".join(f" + CASE WHEN contains(lower(title), '{w}') OR contains(lower(content), '{w}') THEN 1 ELSE 0 END + CASE WHEN list_contains(tags, '{w}') THEN 3 ELSE 0 END" for w in ("ertion", "thonand", "en"))} AS score FROM notes WHERE deleted_at IS NULL) WHERE score > 0""",
}


def _hybrid_sql(dense: bool) -> str:
    terms = S._driver_tokens(QUERY)
    score = "0.5::DOUBLE * cosine + 0.5::DOUBLE * bm25"
    if dense:
        score = f"CASE WHEN d IS NULL THEN {score} ELSE 0.5::DOUBLE * ({score}) + 0.5::DOUBLE * (d + 1) / 2 END"
    return f"""
WITH {NOTES_SQL}, {CHUNKS_SQL},
tok AS (SELECT id, updated_at, list_filter(regexp_split_to_array(regexp_replace(lower(concat_ws(' ', title, title, content, array_to_string(tags, ' '))), '[^a-z0-9äöüß]+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT list_contains({_STOP}, t) AND len(t) > 1) AS toks FROM notes WHERE deleted_at IS NULL),
stat AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM tok),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf, ln((n - df + 0.5) / (df + 0.5) + 1) AS ib FROM df, stat),
q AS (SELECT term, count(*) AS times, count(*) / {len(terms)} AS qtf FROM (SELECT unnest({_strings(terms)}) AS term) GROUP BY term),
qq AS (SELECT q.term, times, qtf * coalesce(idf, ln((n + 1) / 1) + 1) AS q FROM q LEFT JOIN w USING (term), stat),
qn AS (SELECT sqrt(sum(q * q)) AS qn FROM qq),
s AS (
  SELECT tf.id, sum((tf / len(toks) * idf) * (tf / len(toks) * idf)) AS ww, sum((tf / len(toks) * idf) * q) AS wq,
         sum(ib * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (len(toks) / al))) * times) AS raw
  FROM tf JOIN tok USING (id) JOIN w USING (term) LEFT JOIN qq USING (term), stat GROUP BY tf.id),
a AS (SELECT tok.id, updated_at, coalesce(wq / (sqrt(ww) * qn), 0) AS cosine, coalesce(raw, 0) AS raw FROM tok LEFT JOIN s USING (id), qn),
e AS (SELECT min(raw) AS lo, max(raw) AS hi FROM a),
qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
vs AS (SELECT memory_id AS id, max(list_cosine_similarity(embedding, v)) AS sim FROM chunks, qv WHERE model = 'm0' AND memory_id IN (SELECT id FROM tok) GROUP BY 1),
vt AS (SELECT greatest(0, max(sim)) AS top FROM vs),
band AS (SELECT id, sim AS d FROM vs, vt WHERE sim >= CASE WHEN top > 0 THEN least(top, greatest(0.58, top * 0.86)) ELSE 0.58 END),
b AS (SELECT a.id, updated_at, cosine, CASE WHEN hi - lo > 1e-9 THEN (raw - lo) / (hi - lo) ELSE (raw > 0)::INT END AS bm25, d FROM a LEFT JOIN band USING (id), e),
c AS (SELECT *, {score} AS score FROM b)
SELECT id, round(score, 9) AS score, round(cosine, 9) AS cosine, round(bm25, 9)::DOUBLE AS bm25 FROM c WHERE score > 1e-9 ORDER BY c.score DESC, updated_at DESC, id LIMIT 20
"""


ORACLE["ret_tfidf_hybrid"] = _hybrid_sql(False)
ORACLE["ret_dense_hybrid"] = _hybrid_sql(True)
