"""Registered text and classification queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import numbers as N
from ..functions import text as X
from ..sources.tables import NOTES_SQL, NOW_MS, notes, table

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def q(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _note(f):
    """A query that selects from the notes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(notes(spark, sf_dir))

    return run


@_note
def str_terms(n: DataFrame) -> DataFrame:
    return n.select("id", F.array_join(X.content_terms(F.col("content")), " ").alias("terms"))


@_note
def str_tokens(n: DataFrame) -> DataFrame:
    return n.select("id", F.size(X.client_tokens(F.col("content"), 2)).alias("n"), F.array_join(F.slice(X.client_tokens(F.col("title"), 2), 1, 8), " ").alias("tokens"))


@_note
def str_shingles(n: DataFrame) -> DataFrame:
    s = X.shingles(F.col("title"), F.col("content"))
    return n.select("id", F.size(s).alias("n_shingles"), F.get(s, 0).alias("first"))


@_note
def str_sanitize(n: DataFrame) -> DataFrame:
    return n.select("id", F.md5(X.sanitize_text(F.col("content")).cast("binary")).alias("text_md5"), X.sanitize_title(F.col("content")).alias("title"), F.array_join(X.sanitize_tags(F.transform("tags", lambda t: F.concat(F.lit(" #"), F.upper(t)))), ",").alias("tags"))


@_note
def str_normal(n: DataFrame) -> DataFrame:
    return n.select("id", X.normal_form(F.col("title")).alias("title"), F.length(X.normal_form(F.col("content"))).alias("n"))


@_note
def str_stems(n: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return n.select("id", F.size(words).alias("n"), F.md5(F.array_join(F.transform(words, X.stem), " ").cast("binary")).alias("stems_md5"))


def str_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).select("id", F.concat(F.lit("see [["), "title", F.lit("|x]] and [["), F.element_at("tags", 2), F.lit("]] and [["), F.element_at("tags", 2), F.lit("]]")).alias("c"))
    return rows.select("id", F.array_join(X.wiki_links(F.col("c")), "|").alias("links"))


def str_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("## "), F.substring("title", 1, 30), F.lit("\n```\n# hidden name\n```\nsee [["), F.element_at("tags", 2), F.lit("|s]] in [[Overview]]\n"), "content")
    return notes(spark, sf_dir).select("id", F.array_join(X.concepts(text), "|").alias("concepts"))


def str_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


def str_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("- [ ] call **"), F.element_at("tags", 1), F.lit("** about [["), F.element_at("tags", 2), F.lit("|it]]\n- [x] done\n"), F.coalesce("content", F.lit("")))
    return notes(spark, sf_dir).select("id", F.explode(X.todos(text)).alias("todo"))


@_note
def str_source(n: DataFrame) -> DataFrame:
    s = X.source_of(F.concat_ws("", "content", F.lit("\n— Source: /home/u/"), F.element_at("tags", 2), F.lit(".md")))
    return n.select("id", s["kind"].alias("kind"), s["name"].alias("name"), s["path"].alias("path"), s["ext"].alias("ext"))


@_note
def str_file_names(n: DataFrame) -> DataFrame:
    """SNK-02 names: unique without regard to letter case, -2, -3 ... behind repeated ones."""
    from pyspark.sql import Window

    named = n.select("id", X.file_name(F.substring("title", 1, 12)).alias("name"))
    nth = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))
    return named.select("id", F.concat("name", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(""), F.lit(".md")).alias("file"))


def str_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import SYNONYMS

    lexicon = spark.createDataFrame([(k, i, v) for k, vs in SYNONYMS.items() for i, v in enumerate(vs)], "term string, pos int, synonym string")
    asked = notes(spark, sf_dir).select("id", F.posexplode(F.array(F.lit("backup"), F.lit("invoice"), F.element_at("tags", 1), F.lit("server"))).alias("at", "term"))
    terms = asked.groupBy("id").agg(F.collect_set("term").alias("terms"))
    more = asked.join(F.broadcast(lexicon), "term").join(terms, "id").where(~F.array_contains("terms", F.col("synonym")))
    first = more.groupBy("id", "synonym").agg(F.min(F.struct("at", "pos")).alias("p"))
    return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "synonym"))), lambda x: x["synonym"]), " ").alias("added"))


def str_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("id", F.posexplode(X.chunk_text(F.col("content"))).alias("seq", "chunk"))


@_note
def cls_type(n: DataFrame) -> DataFrame:
    t = C.note_type(F.col("title"), F.col("content"), F.col("tags"), F.concat("id", F.when(F.substring("id", -1, 1) == "7", ".pdf").otherwise(".md")))
    return n.select("id", t["type"].alias("type"), t["reason"].alias("reason"))


@_note
def cls_shape(n: DataFrame) -> DataFrame:
    return n.select("id", C.numbered_steps(F.col("content")).alias("steps"), C.bullets(F.col("content")).alias("bullets"))


def cls_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.round(C.markup_share(F.col("html")), 9).alias("share"))


@_note
def cls_carrier(n: DataFrame) -> DataFrame:
    at = F.substring("id", 2, 20).cast("long")
    tags = F.when(at % 3 == 0, F.array(F.lit("machine-scan"), F.element_at("tags", 1))).otherwise(F.col("tags"))
    path = F.when(at % 2 == 0, F.concat(F.lit("/data/"), "id", F.element_at(F.array(*[F.lit(x) for x in (".json", ".py", ".md", ".xyz", "")]), (at % 5 + 1).cast("int"))))
    return n.select("id", C.carrier(F.coalesce("content", F.lit("")), tags, path).alias("carrier"))


@_note
def cls_topics(n: DataFrame) -> DataFrame:
    found = n.select("id", F.explode(F.array(C.topics(F.concat("title", F.lit(" shop")), F.col("content"), F.lit("notes")))).alias("found"))
    return found.select("id", F.explode(C.topic_bucket(F.col("found"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@_note
def cls_unusable(n: DataFrame) -> DataFrame:
    return n.select("id", C.unusable(F.col("content")).alias("reason")).where("reason IS NOT NULL")


@_note
def cls_provenance(n: DataFrame) -> DataFrame:
    at = F.substring("id", 2, 20).cast("long")
    tags = F.when(at % 3 == 0, F.array(F.lit("Machine-Scan"))).when(at % 3 == 1, F.array(F.lit("inbox"))).otherwise(F.col("tags"))
    return n.groupBy(C.provenance(tags).alias("provenance")).agg(F.count("*").alias("n"))


@_note
def cls_first_mark(n: DataFrame) -> DataFrame:
    return n.groupBy(C.first_mark(F.col("tags"), ["src3", "de", "src5", "en"]).alias("mark")).agg(F.count("*").alias("n"))


@_note
def cls_rarest_tag(n: DataFrame) -> DataFrame:
    """CLS-07: each note's rarest tag, ties by name."""
    each = n.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    counts = each.groupBy("tag").agg(F.count("*").alias("n"))
    return each.join(counts, "tag").groupBy("id").agg(F.min(F.struct("n", "tag")).alias("m")).select("id", F.col("m.tag").alias("tag"))


@_note
def dat_buckets(n: DataFrame) -> DataFrame:
    shifted = F.col("updated_at") + F.lit(NOW_MS - 1704067200000 - 40 * N.DAY_MS)
    return n.groupBy(N.age_bucket(shifted, NOW_MS).alias("bucket"), N.list_period(shifted, NOW_MS).alias("period"), N.lens_column(shifted, NOW_MS).alias("lens")).agg(F.count("*").alias("n"))


@_note
def dat_iso(n: DataFrame) -> DataFrame:
    iso = F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    session = F.date_format(F.timestamp_millis("created_at"), "yyyy/MM/dd (EEE) HH:mm")
    return n.select("id", N.epoch_of_iso(iso).alias("ms"), N.session_date(session).alias("session_ms"), N.relative_time(F.col("created_at"), NOW_MS).alias("ago"))


def mth_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-07 over amounts written in several ways."""
    n = F.col("o_orderkey")
    text = F.when(n % 4 == 0, F.concat(n, F.lit(",5"))).when(n % 4 == 1, F.concat(F.lit("1."), F.lpad((n % 1000).cast("string"), 3, "0"))).when(n % 4 == 2, F.concat(F.lit("1."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(",25"))).otherwise(n.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.plain_number(text).alias("number"))


def mth_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-09 over ids as card numbers and account numbers."""
    digits = F.lpad((F.col("o_orderkey") * 7919 + 4_000_000).cast("string"), 12, "4")
    account = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 98).cast("string"), 2, "0"), F.lit("500105170123"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return table(spark, sf_dir, "orders").select(F.count_if(N.luhn(digits)).alias("cards"), F.count_if(N.iban(account)).alias("accounts"))


@_note
def mth_retention(n: DataFrame) -> DataFrame:
    return n.select("id", F.round(N.retention(F.col("last_access_at"), F.col("access_count"), F.col("utility"), NOW_MS), 9).alias("retention"), F.round(N.recency(F.col("updated_at"), NOW_MS), 9).alias("recency"), X.token_estimate(F.col("content")).alias("tokens"))


@_note
def mth_overlaps(n: DataFrame) -> DataFrame:
    a, b = X.content_terms(F.col("content"), 40), X.content_terms(F.reverse("title"), 40)
    c = X.content_terms(F.col("title"), 40)
    return n.select("id", F.round(N.jaccard(F.array_distinct(a), F.array_distinct(c)), 9).alias("jaccard"), F.round(N.overlap(F.array_distinct(a), F.array_distinct(c)), 9).alias("overlap"), N.signature_length(F.size(a), 0.85).alias("signature"), F.size(b).alias("n"))


@_note
def jsn_tags(n: DataFrame) -> DataFrame:
    text = F.when(F.substring("id", -1, 1) == "3", "[broken").otherwise(F.to_json("tags"))
    return n.select("id", F.array_join(N.tags_of_json(text), ",").alias("tags"))


QUERIES = {
    "str_terms": str_terms, "str_tokens": str_tokens, "str_shingles": str_shingles, "str_sanitize": str_sanitize, "str_normal": str_normal, "str_stems": str_stems,
    "str_wikilinks": str_wikilinks, "str_concepts": str_concepts, "str_html_text": str_html_text, "str_todos": str_todos, "str_source": str_source, "str_file_names": str_file_names,
    "str_synonyms": str_synonyms, "str_chunks": str_chunks, "cls_type": cls_type, "cls_shape": cls_shape, "cls_markup": cls_markup, "cls_carrier": cls_carrier, "cls_topics": cls_topics,
    "cls_unusable": cls_unusable, "cls_provenance": cls_provenance, "cls_first_mark": cls_first_mark, "cls_rarest_tag": cls_rarest_tag, "dat_buckets": dat_buckets, "dat_iso": dat_iso,
    "mth_numbers": mth_numbers, "mth_checks": mth_checks, "mth_retention": mth_retention, "mth_overlaps": mth_overlaps, "jsn_tags": jsn_tags,
}

_N = f"WITH {NOTES_SQL}"


def terms_sql(c: str, most: int = 12) -> str:
    raw = f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda t: len(t) > 1)"
    return f"(CASE WHEN len(list_filter({raw}, lambda t: NOT list_contains({_STOP}, t))) > 0 THEN list_filter({raw}, lambda t: NOT list_contains({_STOP}, t)) ELSE {raw} END)[1:{most}]"


def _words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9äöüß]+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT list_contains({_STOP}, t) AND len(t) > 1)"


_PAIRED = "list_concat({w}, list_transform(list_zip({w}[1:len({w}) - 1], {w}[2:]), lambda p: p[1] || '_' || p[2]))"
_CW = "list_filter(regexp_split_to_array(lower(concat_ws(' ', title, content)), '[^\\p{L}\\p{N}]+'), lambda t: len(t) > 1 OR regexp_matches(t, '\\d'))"
_SPACES = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _clean(c: str, most: int) -> str:
    return f"regexp_replace(substr(regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 1, {most}), '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _html_sql() -> str:
    c = "html"
    for tag in X._SILENT:
        c = f"regexp_replace({c}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    for a, b in (("(?s)<!--.*?-->", "' '"), ("(?i)</(p|div|li|tr|h[1-6]|section|article|blockquote)>", "chr(10)"), ("(?i)<br\\s*/?>", "chr(10)"), ("<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), ("(?i)&quot;", "'\"'"), ("&#39;", "''''"), ("[ \\t]+", "' '"), ("[ \\t]*\\n[ \\t]*", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''")):
        c = f"regexp_replace({c}, '{a}', {b}, 'g')"
    c = f"array_to_string(list_filter(string_split({c}, chr(10)), lambda x: NOT (len(trim(x)) BETWEEN 1 AND 60 AND regexp_matches(trim(x), '{X._NAVIGATION}'))), chr(10))"
    return f"regexp_replace(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def _first_sql(c: str, words: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({c}, '{w}') THEN '{w}' END" for w in words) + ")"


_LINES = "regexp_split_to_array(content, '\\r?\\n')"
_STEPS = f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{C.STEP}')))"
_BULLETS = f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{C.BULLET}')))"
_DATE = "\\b(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}\\.\\d{1,2}\\.\\d{2,4}|\\d{1,2}/\\d{1,2}/\\d{2,4})\\b"


def _share(c: str) -> str:
    return f"CASE WHEN len({c}) > 0 THEN (len({c}) - len(regexp_replace({c}, '{C.TAG}', '', 'g'))) / len({c}) ELSE 0 END"


def chunks_sql(c: str) -> str:
    """STR-04 as a fold over the paragraphs, or over their sentences where one is long; the open chunk is the last of the list."""
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '\\n\\s*\\n'), lambda p: trim(p, ' ')), lambda p: len(p) > 0)"
    cut = "list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(s) > 0)"
    sentences = f"flatten(list_transform({paragraphs}, lambda p: CASE WHEN len(p) <= 1200 THEN [p] ELSE {cut} END))"

    def pack(pieces: str, glue: str, fresh: str) -> str:
        fits = f"len(a[-1]) + {2 if glue != ' ' else 1} + len(x[1]) <= 1200"
        join = "chr(10) || chr(10)" if glue != " " else "' '"
        return f"CASE WHEN len({pieces}) = 0 THEN []::VARCHAR[] ELSE list_reduce(list_transform({pieces}, lambda y: [y]), lambda a, x: CASE WHEN {fits} THEN list_concat(a[1 : len(a) - 1], [a[-1] || {join} || x[1]]) ELSE list_concat(a, [{fresh}]) END) END"

    long = f"len(list_filter({paragraphs}, lambda p: len(p) > 1200)) > 0"
    return f"CASE WHEN {long} THEN {pack(sentences, ' ', "right(a[-1], 150) || ' ' || x[1]")} ELSE {pack(paragraphs, 'n', 'x[1]')} END"


def concepts_sql(c: str) -> str:
    """STR-16."""
    fence = "(?ms)^\\s*(```|~~~)[^\\n]*$.*?(^\\s*(```|~~~)[^\\n]*$|\\z)"
    lines = f"string_split(regexp_replace(coalesce({c}, ''), '{fence}', '', 'g'), chr(10))"
    named = f"flatten(list_transform({lines}, lambda x: list_concat(list_filter([regexp_extract(x, '^#{{1,6}}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)], lambda h: h <> ''), regexp_extract_all(x, '\\[\\[([^\\[\\]]{{2,80}})\\]\\]', 1))))"
    flat = f"list_transform({named}, lambda x: lower(trim(regexp_replace(split_part(x, '|', 1), '\\s+', ' ', 'g'))))"
    frame = "[" + ", ".join(f"'{w}'" for w in X.FRAME_WORDS) + "]"
    real = f"list_filter({flat}, lambda n: len(n) BETWEEN 4 AND 40 AND regexp_matches(n, '^[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}} .''&-]*$') AND regexp_matches(n, '\\p{{L}}') AND len(string_split(n, ' ')) <= 4 AND NOT (ends_with(n, '.') AND len(regexp_replace(string_split(n, ' ')[-1], '\\.$', '')) > 3) AND NOT list_contains({frame}, n))"
    return f"list_filter({real}, lambda n, i: list_position({real}, n) = i)[1:40]"


_RAW = "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"
_SHIFTED = f"(updated_at + {NOW_MS - 1704067200000 - 40 * N.DAY_MS})"

def type_sql(rows: str, taken: str = "false") -> str:
    """CLS-01 over rows (id, title, content, tags, ...): column ``k`` with type and reason; ``taken``: whether the path is that of a document."""
    return f"""c AS (SELECT *, {_STEPS} AS steps, {_BULLETS} AS bul, coalesce({_first_sql('lower(title)', C.HOW_TO)}, {_first_sql('substr(lower(content), 1, 400)', C.HOW_TO)}) AS how, {_first_sql('lower(title)', C.EVENTS)} AS ev FROM {rows}),
r AS (SELECT *, CASE WHEN steps >= 3 THEN ['procedural', steps || ' numbered steps'] WHEN how IS NOT NULL AND (steps >= 1 OR bul >= 3 OR contains(lower(title), how)) THEN ['procedural', 'says ' || how]
 WHEN ev IS NOT NULL THEN ['episodic', ev || ' in the title'] WHEN regexp_matches(title, '{_DATE}') THEN ['episodic', 'date in the title'] WHEN len(list_filter(tags, lambda t: list_contains({q(C.EVENTS)}, lower(t)))) > 0 THEN ['episodic', 'tag of an event']
 WHEN {_share('content')} > 0.25 THEN ['reference', 'mostly markup'] WHEN {taken} THEN ['reference', 'taken from .pdf'] ELSE ['semantic', 'plain text'] END AS k FROM c)"""


def unusable_sql(rows: str) -> str:
    """CLS-05 over rows (id, content): table ``u`` (id, reason)."""
    return f"""a AS (SELECT id, {_RAW} AS raw FROM {rows}),
b AS (SELECT id, raw, regexp_extract_all(regexp_replace(raw, '{C.TAG}', ' ', 'g'), '\\p{{L}}[\\p{{L}}\\-'']{{2,}}') AS w, list_filter(list_transform(regexp_split_to_array(raw, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM a),
f AS (SELECT id, max(c) AS most FROM (SELECT id, form, count(*) AS c FROM (SELECT id, substr(regexp_replace(regexp_replace(unnest(l), '\\d+', '#', 'g'), '\\s+', ' ', 'g'), 1, 60) AS form FROM b) GROUP BY ALL) GROUP BY id),
u AS (SELECT b.id, CASE WHEN len(raw) < 20 THEN 'nearly empty' WHEN {_share('raw')} > 0.4 THEN 'mostly markup' WHEN len(raw) > 300 AND len(w) < 20 THEN 'many characters, few words'
 WHEN len(l) >= 8 AND most / len(l) > 0.7 THEN 'one form of line' WHEN len(w) >= 40 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) < 0.12 THEN 'few different words' END AS reason FROM b LEFT JOIN f USING (id))"""


_MARKED = "'## ' || substr(title, 1, 30) || chr(10) || '```' || chr(10) || '# hidden name' || chr(10) || '```' || chr(10) || 'see [[' || tags[2] || '|s]] in [[Overview]]' || chr(10) || content"

ORACLE = {
    "str_concepts": f"{_N} SELECT id, array_to_string({concepts_sql(_MARKED)}, '|') AS concepts FROM notes",
    "str_chunks": f"{_N}, k AS (SELECT id, {chunks_sql('content')} AS k FROM notes) SELECT id, i - 1 AS seq, k[i] AS chunk FROM k, unnest(range(1, len(k) + 1)) AS t(i)",
    "str_terms": f"{_N} SELECT id, array_to_string({terms_sql('content')}, ' ') AS terms FROM notes",
    "str_tokens": f"{_N}, w AS MATERIALIZED (SELECT id, {_words_sql('content')} AS c, {_words_sql('title')} AS t FROM notes) SELECT id, len(c) + greatest(len(c) - 1, 0) AS n, array_to_string({_PAIRED.format(w='t')}[1:8], ' ') AS tokens FROM w",
    "str_shingles": f"{_N}, w AS (SELECT id, {_CW} AS w FROM notes), s AS (SELECT id, CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS s FROM w) SELECT id, len(list_distinct(s)) AS n_shingles, s[1] AS first FROM s",
    "str_sanitize": f"{_N} SELECT id, md5({_clean('content', 50_000)}) AS text_md5, trim(regexp_replace({_clean('content', 200)}, '[\\r\\n]+', ' ', 'g')) AS title, tags[1] || ',' || tags[2] AS tags FROM notes",
    "str_normal": f"{_N} SELECT id, trim(regexp_replace(lower(title), '{_SPACES}+', ' ', 'g')) AS title, len(trim(regexp_replace(lower(content), '{_SPACES}+', ' ', 'g'))) AS n FROM notes",
    "str_stems": f"{_N}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM notes) SELECT id, len(w) AS n, md5(array_to_string(list_transform(w, lambda x: regexp_replace(x, '(ung|en|er|es|em|e|s|n)$', '')), ' ')) AS stems_md5 FROM w",
    "str_wikilinks": f"{_N}, t AS (SELECT id, regexp_extract_all('see [[' || title || '|x]] and [[' || tags[2] || ']] and [[' || tags[2] || ']]', '\\[\\[([^\\[\\]]{{2,80}})\\]\\]', 1) AS f, tags FROM notes), u AS (SELECT id, list_filter(list_transform(f, lambda x: trim(lower(split_part(x, '|', 1)))), lambda x: x <> '') AS f FROM t) SELECT id, CASE WHEN len(f) = 3 AND f[1] <> f[2] THEN f[1] || '|' || f[2] ELSE f[len(f)] END AS links FROM u",
    "str_html_text": f"SELECT page_id, len(t) AS n, md5(t) AS text_md5 FROM (SELECT page_id, {_html_sql()} AS t FROM pages)",
    "str_todos": f"{_N} SELECT id, 'call ' || tags[1] || ' about ' || tags[2] AS todo FROM notes",
    "str_source": f"{_N} SELECT id, 'file' AS kind, tags[2] || '.md' AS name, '/home/u/' || tags[2] || '.md' AS path, 'md' AS ext FROM notes",
    "str_file_names": f"{_N}, f AS (SELECT id, CASE WHEN trim(nm) = '' THEN 'note' ELSE trim(nm) END AS name FROM (SELECT id, substr(trim(regexp_replace(regexp_replace(substr(title, 1, 12), '[\\\\/:*?\"<>|\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80) AS nm FROM notes)), r AS (SELECT id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM f) SELECT id, name || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS file FROM r",
    "str_synonyms": f"{_N} SELECT id, 'gesichert sicherung snapshot rechnung host' AS added FROM notes",
    "cls_type": _N + ", " + type_sql("notes", "id LIKE '%7'") + " SELECT id, k[1] AS type, k[2] AS reason FROM r",
    "cls_shape": f"{_N} SELECT id, {_STEPS} AS steps, {_BULLETS} AS bullets FROM notes",
    "cls_markup": f"SELECT page_id, round({_share('html')}, 9) AS share FROM pages",
    "cls_carrier": f"""{_N}, p AS (SELECT id, doc_id, content, tags, CASE WHEN doc_id % 2 = 0 THEN ['.json', '.py', '.md', '.xyz', ''][doc_id % 5 + 1] ELSE '' END AS e FROM notes)
SELECT id, CASE WHEN doc_id % 3 <> 0 THEN 'notes' WHEN e = '.json' THEN 'data' WHEN e = '.py' THEN 'code' WHEN e = '.md' THEN 'files' WHEN e = '.xyz' THEN 'other'
 WHEN regexp_matches(content, '(?s)^\\s*(export |import |function |const |let |interface |type |\\w+\\s*\\([^)]*\\)\\s*\\{{|//|#include|SELECT |UPDATE |INSERT |\\{{.*":)') OR regexp_matches(trim(content), '(?s)^\\s*[\\{{\\[].*["''].*["''][,\\}}\\]]') THEN 'code' ELSE 'other' END AS carrier FROM p""",
    "cls_topics": f"{_N}, t AS (SELECT id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title || ' shop' || chr(10) || content, '(?i)\\b({w})\\b') THEN '{k}' END" for k, w in C.TOPICS.items()) + "], lambda x: x IS NOT NULL) AS f FROM notes) SELECT topic, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) = 0 THEN ['no topic'] ELSE f END) AS topic FROM t) GROUP BY topic",
    "cls_unusable": f"{_N}, {unusable_sql('notes')} SELECT id, reason FROM u WHERE reason IS NOT NULL",
    "cls_provenance": f"{_N} SELECT CASE doc_id % 3 WHEN 0 THEN 'machine' WHEN 1 THEN 'file' ELSE 'written' END AS provenance, count(*) AS n FROM notes GROUP BY 1",
    "cls_first_mark": f"{_N} SELECT CASE WHEN tags[2] = 'src3' THEN 'src3' WHEN tags[1] = 'de' THEN 'de' WHEN tags[2] = 'src5' THEN 'src5' WHEN tags[1] = 'en' THEN 'en' END AS mark, count(*) AS n FROM notes GROUP BY 1",
    "cls_rarest_tag": f"{_N}, e AS (SELECT DISTINCT id, unnest(tags) AS tag FROM notes), c AS (SELECT tag, count(*) AS n FROM e GROUP BY tag) SELECT id, tag FROM (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY n, tag) AS r FROM e JOIN c USING (tag)) WHERE r = 1",
    "dat_buckets": f"""{_N}, d AS (SELECT {_SHIFTED} AS moment, ({NOW_MS} - {_SHIFTED}) / 86400000.0 AS days FROM notes)
SELECT CASE WHEN days < 1 THEN 'today' WHEN days < 7 THEN 'this week' WHEN days < 14 THEN '1-2 weeks' WHEN days < 28 THEN '2-4 weeks' ELSE 'older' END AS bucket,
 CASE WHEN moment >= {NOW_MS - NOW_MS % N.DAY_MS} THEN 'today' WHEN moment >= {NOW_MS - NOW_MS % N.DAY_MS - 6 * N.DAY_MS} THEN 'this week' ELSE 'older' END AS period,
 CASE WHEN days > 90 THEN 'older' WHEN days > 30 THEN 'quarter' WHEN days > 7 THEN 'month' WHEN days > 2 THEN 'week' ELSE 'now' END AS lens, count(*) AS n FROM d GROUP BY ALL""",
    "dat_iso": f"{_N}, s AS (SELECT id, created_at, ({NOW_MS} - created_at) // 1000 AS s FROM notes) SELECT id, created_at AS ms, created_at AS session_ms, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' ELSE (s // 86400) || ' d' END AS ago FROM s",
    "mth_numbers": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.5' WHEN 1 THEN (1000 + o_orderkey % 1000)::VARCHAR WHEN 2 THEN (1000 + o_orderkey % 1000) || '.25' ELSE o_orderkey::VARCHAR END AS number FROM orders",
    "mth_checks": """WITH d AS (SELECT lpad((o_orderkey * 7919 + 4000000)::VARCHAR, 12, '4') AS c, ('500105170123' || lpad(o_orderkey::VARCHAR, 6, '0') || '1314' || lpad((o_orderkey % 98)::VARCHAR, 2, '0'))::HUGEINT AS a FROM orders),
l AS (SELECT a, list_sum(list_transform(range(1, 13), lambda i: CASE WHEN i % 2 = 1 THEN (c[i]::INT * 2) // 10 + (c[i]::INT * 2) % 10 ELSE c[i]::INT END)) AS s FROM d)
SELECT count(*) FILTER (WHERE s % 10 = 0) AS cards, count(*) FILTER (WHERE a % 97 = 1) AS accounts FROM l""",
    "mth_retention": f"{_N} SELECT id, round(0.2::DOUBLE + 0.8::DOUBLE * exp(-coalesce(({NOW_MS} - last_access_at) / 86400000.0::DOUBLE, 0) / ((utility + least(access_count, 10) + 0.1::DOUBLE) * 90)), 9) AS retention, round(greatest(0::DOUBLE, 1 - greatest(0, {NOW_MS} - updated_at) / (365 * 86400000.0::DOUBLE)) * 0.15::DOUBLE, 9) AS recency, ceil(len(content) / 3.5)::BIGINT AS tokens FROM notes",
    "mth_overlaps": f"""{_N}, t AS (SELECT id, {terms_sql('content', 40)} AS a, list_distinct({terms_sql('title', 40)}) AS c, len({terms_sql('reverse(title)', 40)}) AS n FROM notes), u AS (SELECT id, a, list_distinct(a) AS d, c, n, len(list_intersect(list_distinct(a), c)) AS i FROM t)
SELECT id, round(CASE WHEN len(d) > 0 AND len(c) > 0 THEN i / (len(d) + len(c) - i) ELSE 0 END, 9) AS jaccard, round(CASE WHEN len(d) > 0 AND len(c) > 0 THEN i / least(len(d), len(c)) ELSE 0 END, 9) AS overlap,
 CASE WHEN len(a) = 0 THEN 0 ELSE greatest(1, least(32, len(a) - ceil(0.85::DOUBLE * len(a)) + 1))::INT END AS signature, n FROM u""",
    "jsn_tags": f"{_N} SELECT id, CASE WHEN id LIKE '%3' THEN '' ELSE tags[1] || ',' || tags[2] END AS tags FROM notes",
}
