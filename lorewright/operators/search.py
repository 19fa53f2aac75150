"""Ranked retrieval (RET-*): word, vector and concept legs, fused by reciprocal rank, boosted, filtered, paged.

A query is one string; its terms are known before the plan is built. The word leg reads their postings alone from a kept
index (:mod:`.index`) where there is one; without it the notes are cut into words, and only the terms' hits go on.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .index import WeightIndex, WordIndex, folded

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Search:
    """What a caller may ask for; the defaults are the engine's."""

    query: str = ""
    limit: int = 10
    offset: int = 0
    tags: tuple[str, ...] = ()
    type: str | None = None
    scope: str | None = None
    valid_since: int | None = None
    as_of: int | None = None
    now_ms: int = 0
    legs: frozenset[str] = field(default_factory=lambda: frozenset({"bm25", "vector", "entity"}))


def words_of(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", query.lower()) if len(t) > 1]


def content_terms(query: str, most: int = X.MAX_QUERY_TERMS) -> list[str]:
    """STR-06 for the query string."""
    raw = [t for t in re.split(r"\s+", re.sub(r"[^\w\s]|_", " ", query.lower())) if len(t) > 1]
    stop = set(X.STOPWORDS)
    return ([t for t in raw if t not in stop] or raw)[:most]


#: One level of query synonyms, German and English, whole words.
SYNONYMS = {
    "gesichert": ["backup", "sicherung", "snapshot"], "backup": ["gesichert", "sicherung", "snapshot"], "sicherung": ["backup", "gesichert"],
    "snapshot": ["momentaufnahme", "backup"], "momentaufnahme": ["snapshot"], "umsatzsteuer": ["vat", "ust"], "vat": ["umsatzsteuer"],
    "abgegeben": ["filing", "einreichen", "deadline"], "einreichen": ["filing", "abgegeben"], "filing": ["einreichen", "abgegeben"],
    "passwort": ["password"], "password": ["passwort"], "kennwort": ["password", "passwort"], "datenbank": ["database", "db"], "database": ["datenbank"],
    "produktion": ["production"], "production": ["produktion"], "mandant": ["client", "kunde"], "kunde": ["client", "mandant"], "client": ["mandant", "kunde"],
    "rechnung": ["invoice"], "invoice": ["rechnung"], "frist": ["deadline"], "deadline": ["frist"], "steuer": ["tax"], "tax": ["steuer"],
    "loeschen": ["delete"], "löschen": ["delete"], "delete": ["loeschen", "löschen"], "wiederherstellen": ["restore"], "restore": ["wiederherstellen"],
    "aufbewahrung": ["retention"], "retention": ["aufbewahrung"], "vertrag": ["contract", "agreement"], "contract": ["vertrag"],
    "verschlüsselung": ["encryption"], "verschluesselung": ["encryption"], "encryption": ["verschlüsselung", "verschluesselung"], "server": ["host", "server"],
    "veranstaltung": ["event"], "event": ["veranstaltung"], "kosten": ["cost", "expenses"], "umsatz": ["revenue", "turnover"],
    "passwörter": ["passwort", "password", "manager"], "zugangsdaten": ["passwort", "password", "zugang", "login"], "wissensgraph": ["graph", "knowledge", "entitäten"],
    "nudeln": ["pasta", "spaghetti"], "koche": ["kochen", "rezept"], "kochen": ["rezept"], "fahrzeug": ["auto", "werkstatt"], "instand": ["werkstatt", "auto"],
}


def expand_query(query: str) -> str:
    """STR-11: synonyms behind the query, none that is there already."""
    terms = words_of(query.strip())
    more: dict[str, None] = {}
    for term in terms:
        more.update(dict.fromkeys(s for s in SYNONYMS.get(term, ()) if s not in terms))
    return " ".join([query.strip(), *more])


def query_pieces(query: str, longest: int = 48, most: int = 4000) -> list[str]:
    """STR-12: words, spans of two to four words and all substrings of a query, three characters or more, in that order."""
    q = query.lower()
    words = [w for w in re.split(r"[^\w]+|_", q) if w]
    found: dict[str, None] = {w: None for w in words if len(w) >= 3}
    for n in (2, 3, 4):
        found.update(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
    for i in range(len(q)):
        for j in range(i + 3, min(len(q), i + longest) + 1):
            found[q[i:j].strip()] = None
    return [p for p in found if len(p) >= 3][:most]


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def corpus_statistics(index: WordIndex, terms: list[str]) -> dict[str, float]:
    """For the distinct terms: number and mean length of the notes, deleted ones too, in how many each term is, and of the
    live notes those with all terms and those with any. A few numbers, fetched."""
    n, mean = index.sizes
    terms = list(dict.fromkeys(folded(t) for t in terms))
    found = index.lookup(terms)
    by_note = found.groupBy("id", "live").agg(F.collect_set("term").alias("terms"))  # as many as the query has, at most
    alive = by_note.where("live")
    counts = by_note.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    both = alive.agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("n")).unionAll(alive.where(F.size("terms") == len(terms)).agg(F.lit("").alias("term"), F.count("*").alias("n")))
    got = {r.term: float(r.n) for r in counts.unionAll(both).collect()}
    return {"n_docs": n, "avg_length": mean, "any": got.get(None, 0.0), "full": got.get("", 0.0)} | {f"df:{t}": got.get(t, 0.0) for t in terms}


def bm25(notes: DataFrame, terms: list[str], stats: dict[str, float] | None = None, index: WordIndex | None = None) -> DataFrame:
    """RET-02: (id, bm25, matched) of the notes that have a term. Statistics include deleted notes, results do not."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return notes.limit(0).select("id", F.lit(0.0).alias("bm25"), F.lit(0).alias("matched"))
    index = index or WordIndex(notes)
    stats = stats or corpus_statistics(index, terms)
    n, mean = stats["n_docs"], stats["avg_length"]
    df = {t: stats[f"df:{t}"] for t in map(folded, terms)}
    idf = F.lit(0.0)
    for term, times in df.items():
        idf = F.when(F.col("term") == term, F.log(F.lit((n - times + 0.5) / (times + 0.5) + 1))).otherwise(idf)
    gain = idf * ((F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * (F.col("length") / F.lit(mean)))))
    return index.lookup(terms).where("live").groupBy("id").agg(F.sum(gain).alias("bm25"), F.count("*").cast("int").alias("matched"))


def bm25_and_or(notes: DataFrame, terms: list[str], limit: int, stats: dict[str, float] | None = None, index: WordIndex | None = None) -> DataFrame:
    """RET-03: if enough notes have all the terms, only those; else all, the best ``limit`` by score, then id."""
    terms = list(dict.fromkeys(terms))
    index = index or WordIndex(notes)
    stats = stats or (corpus_statistics(index, terms) if terms else {"full": 0.0})
    scored = bm25(notes, terms, stats, index)
    if stats["full"] >= limit:
        scored = scored.where(F.col("matched") == len(set(map(folded, terms))))
    return scored.orderBy(F.desc("bm25"), "id").limit(limit)


def bm25_of_queries(index: WordIndex, queries: DataFrame) -> DataFrame:
    """RET-02 for a table of queries (query_id, terms): (query_id, id, bm25), by one join of their terms with the postings."""
    n, mean = index.sizes
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform("terms", X.fold_accents))).alias("term"))
    every, df = index.of_table(asked.select("term").distinct())
    idf = df.select("term", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    gain = F.col("idf") * ((F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * (F.col("length") / F.lit(mean)))))
    return every.where("live").join(asked.join(idf, "term"), "term").groupBy("query_id", "id").agg(F.sum(gain).alias("bm25"))


def vector_leg(chunks: DataFrame, query_vector: list[float], model: str, keep: DataFrame | None = None) -> DataFrame:
    """RET-04: (id, similarity) of each note's best chunk, inside the band below the best note. ``keep``: ids that may appear."""
    near = N.cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in query_vector]))
    best = chunks.where(F.col("model") == model).select(F.col("memory_id").alias("id"), near.alias("similarity")).groupBy("id").agg(F.max("similarity").alias("similarity"))
    if keep is not None:
        best = best.join(keep.select("id"), "id", "left_semi")
    top = best.agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("top"))
    bound = F.when(F.col("top") > 0, F.least("top", F.greatest(F.lit(N.VECTOR_FLOOR), F.col("top") * N.VECTOR_BAND))).otherwise(N.VECTOR_FLOOR)
    return best.crossJoin(F.broadcast(top)).where(F.col("similarity") >= bound).select("id", "similarity", "top")


def entity_leg(mentions: DataFrame, query: str) -> DataFrame:
    """RET-05: (id) of the notes that carry a concept which a piece of the query names."""
    return mentions.where(F.col("entity").isin(query_pieces(query))).select(F.col("memory_id").alias("id")).distinct()


def ranked(rows: DataFrame, leg: str, *order: Column, part: Column | None = None) -> DataFrame:
    """WIN-01: 1-based ranks of a leg. A leg without a bound gives a ``part`` that rises with the order: rows are numbered
    in their part, after those of the parts before, so no task sees the whole leg."""
    if part is None:
        return rows.select("id", F.lit(leg).alias("leg"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    rows = rows.withColumn("__part", part)
    nth = rows.select("id", "__part", F.row_number().over(Window.partitionBy("__part").orderBy(*order)).alias("nth"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return nth.join(starts, "__part").select("id", F.lit(leg).alias("leg"), (F.col("start") + F.col("nth")).cast("int").alias("rank"))


def fuse(legs: DataFrame, vector_weight: Column | float = 1.0) -> DataFrame:
    """RET-06: reciprocal rank fusion of (id, leg, rank)."""
    weight = F.when(F.col("leg") == "vector", vector_weight).otherwise(1.0)
    rank = {leg: F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"{leg}_rank") for leg in ("bm25", "vector", "entity")}
    return legs.groupBy("id").agg(F.sum(weight / (N.RRF_K + F.col("rank"))).alias("rrf"), *rank.values())


def rerank(query: str, title: Column, content: Column, tags: Column) -> Column:
    """RET-08: closeness of a query and a note, 0 to 1; null where the query has no terms."""
    q = query.strip().lower()
    terms = words_of(q)
    if not terms:
        return F.lit(None).cast("double")

    ending = re.compile("(ung|en|er|es|em|e|s|n)$")
    stems_of_terms = [ending.sub("", term) for term in terms]
    # a stem that is one of these, begins with one or is the beginning of one has its first letter, or none
    first = sorted({st[:1] for st in stems_of_terms if st})

    def near_terms(w: Column) -> Column:
        out = w.isin("ung", "en", "er", "es", "em", "e", "s", "n")
        for letter in first:
            out = w.startswith(letter) | out
        return out

    def stems(c: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), near_terms), X.stem))

    def judged(in_title: Column, in_text: Column) -> Column:
        def near(st: str) -> Column:
            return F.exists(in_text, lambda d: d.startswith(st) | F.lit(st).startswith(d))

        tag_stems = F.transform(tags, lambda t: X.stem(F.lower(t)))
        coverage, title_coverage, tag = F.lit(0.0), F.lit(0.0), F.lit(False)
        for st in stems_of_terms:
            loose = near(st) if len(st) >= 4 else F.lit(False)
            coverage = coverage + F.when(F.array_contains(in_text, st), 1.0).when(loose, 0.6).otherwise(0.0)
            title_coverage = title_coverage + F.array_contains(in_title, st).cast("double")
            tag = tag | F.array_contains(tag_stems, st)
        score = coverage / len(terms) * 0.6 + F.least(title_coverage / len(terms), F.lit(1.0)) * 0.2
        score = score + F.when(F.lower(content).contains(q), 0.15).otherwise(0.0) + F.when(F.lower(title).contains(q), 0.25).otherwise(0.0) + F.when(tag, 0.1).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    def with_title(in_title: Column) -> Column:
        return X.once(F.array_union(stems(content), in_title), lambda in_text: judged(in_title, in_text))

    return X.once(stems(title), with_title)


def search_filter(s: Search) -> Column:
    """FLT-01; applied after ranking, so ranks are those of the whole corpus."""
    keep = F.lit(True)
    if s.type:
        keep = keep & (F.col("type") == s.type)
    if s.scope:
        keep = keep & (F.col("scope") == s.scope)
    for t in s.tags:
        keep = keep & F.array_contains("tags", t.lower())
    if s.valid_since is not None:
        keep = keep & (F.col("valid_from").isNull() | (F.col("valid_from") >= s.valid_since))
    if s.as_of is not None:
        keep = keep & N.visible_at(F.col("valid_from"), F.col("created_at"), F.col("valid_to"), s.as_of)
    return keep


def search(notes: DataFrame, s: Search, *, chunks: DataFrame | None = None, query_vector: list[float] | None = None, model: str = "m0", mentions: DataFrame | None = None, policy: Column | None = None, index: WordIndex | None = None) -> DataFrame:
    """RET-07, RET-09 to RET-11, SRT-01 to SRT-03: the whole search.

    Returns one page: id, score, the parts of the score, ``matched_terms``, ``expired``, ``superseded`` and ``total``, the
    number of hits before paging. Ties: newer first, then id. Only the page meets its matched terms.
    """
    query = expand_query(s.query)
    now = s.as_of if s.as_of is not None else s.now_ms
    live = notes.where("deleted_at IS NULL")
    if query:
        legs, spoke, weight = [], False, 1.0
        if "bm25" in s.legs:
            terms = list(dict.fromkeys(content_terms(query)))
            index = index or WordIndex(notes)
            stats = corpus_statistics(index, terms) if terms else {"full": 0.0, "any": 0.0}
            spoke = stats["any"] > 0
            depth = min(10_000, max(500, 2 * (s.offset + s.limit)))
            legs.append(ranked(bm25_and_or(notes, terms, depth, stats, index), "bm25", F.desc("bm25"), F.col("id")))
        if "entity" in s.legs and mentions is not None:
            named = entity_leg(mentions, query).join(live.select("id"), "id", "left_semi")
            spoke = spoke or not named.isEmpty()
            legs.append(ranked(named, "entity", F.col("id"), part=F.substring("id", 1, 4)))
        vectors = None
        if "vector" in s.legs and chunks is not None and query_vector is not None:
            vectors = vector_leg(chunks, query_vector, model, live)
            legs.append(ranked(vectors, "vector", F.desc("similarity"), F.col("id"), part=F.floor(-1000 * F.col("similarity"))))
            if spoke:  # a weak vector leg has no vote beside another leg
                top = vectors.agg(F.max("top").alias("top")).first().top
                weight = 1.0 if top is not None and top >= N.VECTOR_FLOOR else 0.0
        every = legs[0] if legs else ranked(notes.limit(0).select("id"), "bm25", F.col("id"))
        for leg in legs[1:]:
            every = every.unionAll(leg)
        hits = fuse(every, weight).join(live, "id")
        if vectors is not None:
            hits = hits.join(vectors.select("id", "similarity"), "id", "left")
        else:
            hits = hits.withColumn("similarity", F.lit(None).cast("double"))
        score = F.col("rrf")
    else:
        hits = live.select("*", *[F.lit(None).cast("int").alias(f"{leg}_rank") for leg in ("bm25", "vector", "entity")], F.lit(None).cast("double").alias("similarity"))
        score = F.lit(0.0)
    expired = F.lit(False) if s.as_of is not None else F.coalesce(F.col("valid_to") < now, F.lit(False))
    closeness = rerank(query, F.col("title"), F.col("content"), F.col("tags"))
    score = score * (1 + N.recency(F.col("updated_at"), now)) * (0.5 + 0.5 * F.col("confidence")) * N.retention(F.col("last_access_at"), F.col("access_count"), F.col("utility"), now)
    score = score * F.when(expired, N.EXPIRED).otherwise(1.0) * F.when(F.col("superseded_by").isNotNull(), N.SUPERSEDED).otherwise(1.0)
    score = score * F.coalesce(1 + closeness * N.RERANK_BOOST, F.lit(1.0))
    hits = hits.where(search_filter(s))
    if policy is not None:
        hits = hits.where(policy)
    hits = hits.select("id", "title", "content", score.alias("score"), "bm25_rank", "vector_rank", "entity_rank", "similarity", closeness.alias("rerank"), expired.alias("expired"), F.col("superseded_by").isNotNull().alias("superseded"), "updated_at")
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(F.desc("score"), F.desc("updated_at"), "id").offset(s.offset).limit(s.limit)
    terms = F.filter(_literals(words_of(query)), lambda t: F.lower(F.col("title")).contains(t) | F.lower(F.col("content")).contains(t))
    return page.crossJoin(F.broadcast(total)).withColumn("matched_terms", terms).drop("content")


def hybrid(notes: DataFrame, query: str, top_k: int = 5, cosine_weight: float = 0.5, ngram: int = 1, dense: DataFrame | None = None, dense_weight: float = 0.5, index: WeightIndex | None = None) -> DataFrame:
    """RET-12 to RET-14: TF-IDF cosine and min-max BM25, title tokens counted twice; ``dense`` (id, cosine) adds a mapped vector score.

    A kept ``index`` (of the same notes and ``ngram``) has the norms of all notes; a query then reads the postings of its
    own terms and one row of each note that has one.
    """
    terms = _driver_tokens(query, ngram)
    if not terms:
        return notes.orderBy(F.desc("updated_at"), "id").limit(top_k).select("id", F.lit(1.0).alias("score"), F.lit(1.0).alias("cosine"), F.lit(1.0).alias("bm25"))
    index = index or WeightIndex.of(notes, ngram)
    n, mean = index.sizes
    distinct = list(dict.fromkeys(terms))
    found = index.lookup(distinct)
    df = {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
    # terms that no note has weigh as if their frequency were zero
    asked = [(t, math.log((n + 1) / (df.get(t, 0) + 1)) + 1, math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5) + 1), terms.count(t)) for t in distinct]
    q_norm = math.sqrt(sum((times / len(terms) * idf) ** 2 for _, idf, _, times in asked))
    idf, idf_bm25, times = F.lit(0.0), F.lit(0.0), F.lit(0)
    for t, a, b, k in asked:
        idf, idf_bm25, times = (F.when(F.col("term") == t, v).otherwise(c) for c, v in ((idf, a), (idf_bm25, b), (times, k)))
    dot = F.col("tf") / F.col("length") * idf * (times / len(terms) * idf)
    gain = idf_bm25 * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * (F.col("length") / F.lit(mean or 1.0)))) * times
    hits = found.groupBy("id").agg(F.sum(dot).alias("wq"), F.sum(gain).alias("raw"))
    if dense is not None:
        hits = hits.join(dense.select("id", F.col("cosine").alias("dense")), "id", "full_outer")
    raw = F.coalesce("raw", F.lit(0.0))
    scored = hits.join(index.docs, "id").select("id", "updated_at", F.coalesce(F.col("wq") / (F.sqrt("ww") * q_norm), F.lit(0.0)).alias("cosine"), raw.alias("raw"), *(["dense"] if dense is not None else []))
    # the notes without a term, if there are any, have the lowest score: zero
    ends = scored.agg(F.when(F.count_if(F.col("raw") > 0) < n, 0.0).otherwise(F.min("raw")).alias("low"), F.coalesce(F.max("raw"), F.lit(0.0)).alias("high"))
    spread = F.col("high") - F.col("low")
    scored = scored.crossJoin(F.broadcast(ends)).withColumn("bm25", F.when(spread > 1e-9, (F.col("raw") - F.col("low")) / spread).otherwise((F.col("raw") > 0).cast("double")))
    score = cosine_weight * F.col("cosine") + (1 - cosine_weight) * F.col("bm25")
    if dense is not None:
        score = F.when(F.col("dense").isNull(), score).otherwise((1 - dense_weight) * score + dense_weight * (F.col("dense") + 1) / 2)
    return scored.withColumn("score", score).where("score > 1e-9").orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(top_k).select("id", "score", "cosine", "bm25")


def _driver_tokens(text: str, ngram: int = 1) -> list[str]:
    words = [t for t in re.sub("[^a-z0-9äöüß]+", " ", text.lower()).split() if t not in set(X.STOPWORDS) and len(t) > 1]
    return words + ["_".join(words[i : i + n]) for n in range(2, ngram + 1) for i in range(len(words) - n + 1)]


def naive(notes: DataFrame, query: str) -> DataFrame:
    """RET-15: substring baseline: title 10, any text 5, each word 1, each tag 3."""
    q = query.strip().lower()
    title, content = F.lower("title"), F.lower("content")
    score = F.when(title.contains(q), 10).otherwise(0) + F.when(title.contains(q) | content.contains(q), 5).otherwise(0)
    for word in [w for w in q.split() if w]:
        score = score + F.when(title.contains(word) | content.contains(word), 1).otherwise(0) + F.when(F.array_contains("tags", word), 3).otherwise(0)
    return notes.where("deleted_at IS NULL").select("id", score.alias("score")).where("score > 0")


def metrics(hits: DataFrame, relevant: DataFrame, depth: int = 5) -> DataFrame:
    """AGG-24: hits (query_id, id, rank) against relevant (query_id, id, category): Hit@1, capped recall, precision and MRR by category."""
    need = relevant.groupBy("query_id", "category").agg(F.count("*").alias("need"))
    got = hits.join(relevant.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= depth).alias("found"), F.min("rank").alias("first"))
    per = need.join(got, "query_id", "left").select(
        "category",
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("hit"),
        (F.coalesce("found", F.lit(0)) / F.least("need", F.lit(depth))).alias("recall"),
        (F.coalesce("found", F.lit(0)) / depth).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )
    return per.groupBy("category").agg(F.avg("hit").alias("hit_at_1"), F.avg("recall").alias("recall_at_5"), F.avg("precision").alias("precision_at_5"), F.avg("rr").alias("mrr"), F.count("*").alias("queries"))


def first_wins(lists: DataFrame) -> DataFrame:
    """SET-04, RET-16: union of several result lists (list, rank, id): each id once, where it first comes."""
    w = Window.partitionBy("id").orderBy("list", "rank")
    return lists.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


TIME_QUESTION = re.compile(r"\b(how (long|many (days|weeks|months|years))|when|before|after|first|last|order|wie lange|wann|vor|nach|zuerst|zuletzt)\b", re.I)


def time_questions(question: str, most: int = 3) -> list[str]:
    """RET-16: a question about times, split at its joints into sub-questions; others have none."""
    if not TIME_QUESTION.search(question):
        return []
    parts = [p.strip(" ?.,") for p in re.split(r"\b(?:and|or|before|after|since|until|between|und|oder|bevor|nachdem|seit|bis)\b", question, flags=re.I)]
    return [p for p in parts if len(p) > 8][:most]


def pack(hits: DataFrame, budget: int, most: int = 24) -> DataFrame:
    """WIN-05, RET-18: hits (rank, id, tokens) that fit a token budget: the first always, later ones if they still fit.

    The fold runs over one query's hits, which a page bounds.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "tokens")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids"))

    def add(acc: Column, x: Column) -> Column:
        take = (F.size(acc["ids"]) == 0) | ((acc["used"] + x["tokens"] <= budget) & (F.size(acc["ids"]) < most))
        return F.struct(F.when(take, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(take, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    return hits.agg(F.aggregate(rows, start, add).alias("p")).select("p.used", F.posexplode("p.ids").alias("pos", "id"))


def prompt_block(c_id: Column, title: Column, tags: Column, content: Column) -> Column:
    """RET-18: one hit as a block of a prompt."""
    return F.concat(F.lit("[ID: "), c_id, F.lit(" | TAGS: "), F.array_join(tags, ", "), F.lit(" | TITEL: "), title, F.lit("]\n"), content)


def verbatim_hit(answer: Column, text: Column) -> Column:
    """RET-19: the answer stands in the text, letter case and punctuation aside; an abstention never counts."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    says_nothing = flat(answer).rlike(r"^(i don t know|not enough information|unknown|no answer|keine angabe)$")
    return (flat(answer) != "") & ~says_nothing & flat(text).contains(flat(answer))


def judged(verdict: Column, abstention: Column) -> Column:
    """RET-19, RET-20: yes 1, partly 0.5, no 0; turned round where the right answer is to abstain."""
    points = F.when(F.lower(verdict).rlike(r"^\W*(yes|ja)\b"), 1.0).when(F.lower(verdict).rlike(r"^\W*(part|teil)"), 0.5).otherwise(0.0)
    return F.when(abstention, 1 - points).otherwise(points)
