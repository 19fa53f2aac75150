"""Sources and sinks of notes (SRC-09 to SRC-21, SNK-*): Markdown, chat exports, JSON backups, web pages, folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions import text as X
from ..store import written

_FRONT = T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("body", T.StringType())])


def parse_front_matter(text: str | None) -> tuple[dict[str, str], dict[str, list[str]], str]:
    """SRC-09: scalars and lists between two ``---`` lines, and the text behind them; a text without is all body."""
    text = (text or "").replace("\r\n", "\n")
    if not text.startswith("---\n") or "\n---" not in text[3:]:
        return {}, {}, text
    head, _, body = text[4:].partition("\n---")
    fields: dict[str, str] = {}
    rows: dict[str, list[str]] = {}
    key = ""

    def scalar(v: str) -> str:
        v = v.strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            return v[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        return v

    for line in head.split("\n"):
        stripped = line.strip()
        if stripped.startswith("- ") and key:
            rows.setdefault(key, []).append(scalar(stripped[2:]))
        elif ":" in line and not line.startswith((" ", "\t")):
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            if value.startswith("[") and value.endswith("]"):
                rows[key] = [scalar(v) for v in value[1:-1].split(",") if v.strip()]
            elif value:
                fields[key] = scalar(value)
    return fields, rows, body.split("\n", 1)[1] if "\n" in body else ""


@F.pandas_udf(_FRONT)
def front_matter(texts: pd.Series) -> pd.DataFrame:
    done = [parse_front_matter(t) for t in texts]
    return pd.DataFrame({"fields": [f for f, _, _ in done], "lists": [r for _, r, _ in done], "body": [b for _, _, b in done]})


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: (name, text) of the Markdown files of a folder, whole."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.md$", "").alias("name"), F.col("value").alias("text"))


def notes_of_markdown(files: DataFrame, now_ms: int, id_key: str = "note_id") -> DataFrame:
    """SRC-10: notes of files (name, text): the title is the front matter's unless that is a template's place holder, else the file's name.

    ``id_key`` is the front matter's key that holds the id.
    """
    rows = files.select("name", front_matter("text").alias("m"))
    said = F.col("m.fields")["title"]
    title = F.when(said.isNull() | said.rlike(r"^\{\{.*\}\}$") | (F.trim(said) == ""), F.col("name")).otherwise(said)
    at = lambda key: F.coalesce(N.epoch_of_iso(F.col("m.fields")[key]), F.col("m.fields")[key].try_cast("long"))
    return rows.select(
        F.coalesce(F.col("m.fields")[id_key], F.concat(F.lit("md-"), F.sha1(title).substr(1, 16))).alias("id"),
        title.alias("title"),
        F.regexp_replace(F.col("m.body"), r"^\s+|\s+$", "").alias("content"),
        F.coalesce(F.col("m.lists")["tags"], F.when(F.col("m.fields")["tags"].isNotNull(), F.array(F.col("m.fields")["tags"])), F.array().cast("array<string>")).alias("tags"),
        F.col("m.fields")["type"].alias("type"),
        F.coalesce(F.col("m.fields")["scope"], F.lit("local")).alias("scope"),
        F.coalesce(F.col("m.fields")["confidence"].try_cast("double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(at("created"), F.lit(now_ms)).alias("created_at"),
        F.coalesce(at("updated"), F.lit(now_ms)).alias("updated_at"),
        at("valid_from").alias("valid_from"),
        at("valid_to").alias("valid_to"),
    )


def import_vault(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """SRC-10: (id, title, action, match): create, update or skip; matched by id, then by title; equal text is skipped."""
    by_id = incoming.join(table.select("id", F.col("id").alias("m1"), F.md5(F.concat_ws("\n", "title", "content").cast("binary")).alias("h1")), "id", "left")
    titles = table.groupBy("title").agg(F.max_by(F.struct(F.col("id").alias("m2"), F.md5(F.concat_ws("\n", "title", "content").cast("binary")).alias("h2")), F.struct("updated_at", "id")).alias("t"))
    both = by_id.join(titles, "title", "left")
    match = F.coalesce("m1", "t.m2")
    same = F.coalesce("h1", "t.h2") == F.md5(F.concat_ws("\n", "title", "content").cast("binary"))
    return both.select("id", "title", F.when(match.isNull(), "create").when(same, "skip").otherwise("update").alias("action"), match.alias("match"))


def wiki_references(notes: DataFrame) -> DataFrame:
    """SRC-10: (source, target, relation) of wiki links between notes' titles."""
    links = notes.select(F.col("id").alias("source"), F.explode(X.wiki_links(F.col("content"))).alias("name"))
    return links.join(notes.select(F.lower(F.trim("title")).alias("name"), F.col("id").alias("target")), "name").where("source <> target").select("source", "target", F.lit("references").alias("relation")).distinct()


def user_turns(turns: DataFrame) -> DataFrame:
    """SRC-11: each user turn of eight characters or more becomes a note with a fixed id; confidence 0.7."""
    rows = turns.where((F.col("role") == "user") & (F.length(F.trim("text")) >= 8))
    return rows.select(F.sha1(F.concat_ws("#", "conv_id", "turn")).substr(1, 16).alias("id"), X.title_of(F.col("text")).alias("title"), F.trim("text").alias("content"), F.lit(0.7).alias("confidence"), "conv_id", "turn")


def conversation_notes(turns: DataFrame, most: int = 12_000) -> DataFrame:
    """SRC-12: one note for each conversation of two turns or more with an answer; turns in order, ``most`` characters each."""
    said = turns.where(F.length(F.trim("text")) > 0)
    line = F.concat(F.when(F.col("role") == "user", "**You:** ").otherwise("**Assistant:** "), F.substring(F.trim("text"), 1, most))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"), F.count("*").alias("turns"), F.count_if(F.col("role") != "user").alias("answers"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    return rows.where("turns >= 2 AND answers >= 1").select("conv_id", X.title_of(F.col("first")).alias("title"), F.array_join(F.transform("t", lambda x: x["line"]), "\n\n").alias("content"), "turns")


def active_branch(messages: DataFrame, current: DataFrame, depth: int = 1 << 30) -> DataFrame:
    """SRC-12: messages (conv_id, id, parent, role, text) on the way from each conversation's current node to its root, with their turn.

    The chain of a tree is walked by doubling: after k rounds a node knows its ancestor 2^k steps up, so long chains take few joins. It ends where no chain
    goes on; ``depth`` only stops chains that go round.
    """
    up = messages.select("conv_id", "id", "parent")
    path = current.select("conv_id", F.col("current").alias("id"), F.lit(0).cast("long").alias("back"))
    hop = written(up.select("conv_id", F.col("id").alias("x"), F.col("parent").alias("y")).where("y IS NOT NULL"))
    step = 1
    while step < depth:
        reach = path.join(hop.select("conv_id", F.col("x").alias("id"), "y"), ["conv_id", "id"]).select("conv_id", F.col("y").alias("id"), (F.col("back") + step).alias("back"))
        path = written(path.unionByName(reach).distinct())
        # two hops of one step are one of the next; both tables are written, else each round would hold all plans before it
        hop = written(hop.select("conv_id", "x", F.col("y").alias("m")).join(hop.select("conv_id", F.col("x").alias("m"), "y"), ["conv_id", "m"]).select("conv_id", "x", "y"))
        if hop.isEmpty():
            break
        step *= 2
    w = Window.partitionBy("conv_id").orderBy(F.desc("back"))
    return path.join(messages, ["conv_id", "id"]).withColumn("turn", F.row_number().over(w) - 1).select("conv_id", "turn", "role", "text")


_MAPPING = "struct<conversation_id:string,title:string,create_time:double,current_node:string,mapping:map<string,struct<parent:string,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>>"
_MESSAGES = "struct<name:string,created_at:string,chat_messages:array<struct<sender:string,text:string>>>"


def chat_export(exports: DataFrame) -> DataFrame:
    """SRC-11, SRC-12: turns (conv_id, turn, role, text) of exported conversations (column ``json``), in either of two layouts."""
    tree = exports.where(F.get_json_object("json", "$.mapping").isNotNull()).select(F.from_json("json", _MAPPING).alias("c"))
    cid = F.coalesce("c.conversation_id", F.sha1("c.title"))
    nodes = tree.select(cid.alias("conv_id"), F.explode("c.mapping").alias("id", "n")).select("conv_id", "id", F.col("n.parent").alias("parent"), F.col("n.message.author.role").alias("role"), F.array_join("n.message.content.parts", "\n").alias("text"))
    walked = active_branch(nodes, tree.select(cid.alias("conv_id"), F.col("c.current_node").alias("current"))).where("role IN ('user', 'assistant') AND length(trim(text)) > 0")
    flat = exports.where(F.get_json_object("json", "$.chat_messages").isNotNull()).select(F.from_json("json", _MESSAGES).alias("c"), F.sha1("json").alias("conv_id"))
    listed = flat.select("conv_id", F.posexplode("c.chat_messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("int"), F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"), F.col("m.text").alias("text"))
    return walked.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(listed)


def merge_backup(table: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """SRC-13: a backup (with ``pos``, its order): the last of repeated ids; merged, the newer of both stays; replaced, only the backup's rows stay."""
    last = incoming.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos")))).where("__r = 1").drop("__r", "pos")
    if replace:
        return last
    both = table.withColumn("__new", F.lit(0)).unionByName(last.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    newest = both.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at"), "__new")))
    return newest.where("__r = 1").drop("__r", "__new")


def migrate(table: DataFrame, legacy: DataFrame) -> DataFrame:
    """SRC-14: rows whose id is not there yet are added."""
    return table.unionByName(legacy.dropDuplicates(["id"]).join(table.select("id"), "id", "left_anti"), allowMissingColumns=True)


def page_notes(pages: DataFrame) -> DataFrame:
    """SRC-15, STR-14: title and text of web pages (page_id, url, html); numeric entities are put back."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", "url", X.sanitize_title(F.replace(title, F.lit("&amp;"), F.lit("&"))).alias("title"), X.html_text(F.col("html")).alias("content"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16, SRC-17: (path, size, text) of the text files below a folder that a scan may read; binary formats have null text."""
    from ..operators.filters import verdict

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = rows.select("path", F.col("length").alias("size"), "content").where(verdict(F.col("path"), F.col("size"), root=path).isNull())
    plain = F.lower("path").rlike(r"\.(md|txt|csv|json|xml|yaml|yml|log|py|ts|js|sql|eml|rtf)$")
    text = F.when(plain, F.try_validate_utf8(F.col("content").cast("string"))).when(F.lower("path").rlike(r"\.html?$"), X.html_text(F.col("content").cast("string")))
    return rows.select("path", "size", F.substring(text, 1, 200_000).alias("text"))


def parts(text: Column, size: int = 2000) -> Column:
    """STR-05, SRC-18: parts of about ``size`` characters, cut at the last blank line or sentence beyond 55 percent of a part, else hard."""
    least = int(size * 0.55)
    cut = rf"(?s).{{{least},{size}}}(?:\n\n|\. )|.{{1,{size}}}"
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(0)), lambda x: F.trim(x)), lambda p: F.length(p) > 0)


def scan_notes(files: DataFrame, table: DataFrame) -> DataFrame:
    """SRC-19: files (path, text): known titles out, keys masked, unusable texts out, typed and stamped."""
    from ..functions import classify as C
    from ..operators.secure import mask

    named = files.withColumn("title", F.regexp_extract("path", r"([^/]+)$", 1)).join(table.select("title").distinct(), "title", "left_anti")
    # a generator, not a projection: else each use below would mask the text again
    clean = named.withColumn("content", F.explode(F.array(mask(F.col("text"))))).where(C.unusable(F.col("content")).isNull())
    tags = F.array(F.lit("machine-scan"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return clean.select(F.sha1("path").substr(1, 16).alias("id"), "title", "content", tags.alias("tags"), C.note_type(F.col("title"), F.col("content"), tags, F.col("path"))["type"].alias("type"))


def longmem_turns(sessions: DataFrame) -> DataFrame:
    """SRC-21: notes of benchmark sessions (question_id, session_id, session_date, turns array): id from session and turn."""
    each = sessions.select("question_id", "session_id", N.session_date(F.col("session_date")).alias("at"), F.posexplode("turns").alias("n", "t"))
    return each.select(F.sha1(F.concat(F.col("session_id"), F.lit("#"), F.col("n"))).substr(1, 16).alias("id"), "question_id", "session_id", "at", F.col("t.role").alias("role"), F.col("t.content").alias("content"))


def dataset_distribution(questions: DataFrame) -> DataFrame:
    """AGG-26: questions, sessions and questions with answers marked, by kind of question."""
    return questions.groupBy("question_type").agg(F.count("*").alias("questions"), F.sum(F.size("sessions")).alias("sessions"), F.count_if(F.size("answers") > 0).alias("marked"))


def to_markdown(notes: DataFrame, id_key: str = "note_id") -> DataFrame:
    """SNK-01, SNK-02: (file, text): notes as Markdown with front matter in a fixed order of keys; file names are unique."""
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tags = F.concat(F.lit("tags: ["), F.array_join(F.transform("tags", X.yaml_value), ", "), F.lit("]"))
    lines = [
        F.lit("---"),
        F.concat(F.lit("title: "), X.yaml_value(F.col("title"))),
        F.when(F.size("tags") > 0, tags),
        F.concat(F.lit("type: "), F.col("type")),
        F.when(F.col("scope") != "local", F.concat(F.lit("scope: "), X.yaml_value(F.col("scope")))),
        F.when(F.col("confidence") < 1, F.concat(F.lit("confidence: "), F.format_number("confidence", 2))),
        F.concat(F.lit("created: "), iso("created_at")),
        F.concat(F.lit("updated: "), iso("updated_at")),
        F.when(F.col("valid_from").isNotNull(), F.concat(F.lit("valid_from: "), iso("valid_from"))),
        F.when(F.col("valid_to").isNotNull(), F.concat(F.lit("valid_to: "), iso("valid_to"))),
        F.concat(F.lit(f"{id_key}: "), F.col("id")),
        F.lit("---"),
        F.lit(""),
        F.col("content"),
    ]
    named = notes.withColumn("name", X.file_name(F.col("title")))
    nth = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))
    return named.select("id", F.concat("name", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(""), F.lit(".md")).alias("file"), F.concat_ws("\n", *lines).alias("text"))


def bundle(notes: DataFrame, scope: str) -> DataFrame:
    """SNK-04: rows of a sync bundle: the notes of a scope that are live and current, one JSON line each with its digest."""
    rows = notes.where((F.col("scope") == scope) & F.col("deleted_at").isNull() & F.col("superseded_by").isNull())
    line = F.to_json(F.struct("id", "title", "content", "tags", "updated_at"))
    return rows.select("id", line.alias("line"), F.sha2(line, 256).alias("sha256"))


def json_page(page: DataFrame, total: DataFrame) -> DataFrame:
    """SNK-06: one row: the page as a JSON list, its SHA-1, the total and whether more follows. A page is bounded by its limit."""
    body = page.agg(F.coalesce(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("id", "title").alias("row")))), lambda x: x["row"])), F.lit("[]")).alias("body"), F.count("*").alias("n"))
    return body.crossJoin(total).select("body", F.sha1("body").alias("etag"), "total", (F.col("n") < F.col("total")).alias("limited"))


def expired_backups(backups: DataFrame, keep: int) -> DataFrame:
    """SNK-07: backups (name, at) beyond the newest ``keep``."""
    newest = backups.orderBy(F.desc("at"), F.desc("name")).limit(keep).select("name")
    return backups.join(newest, "name", "left_anti")
