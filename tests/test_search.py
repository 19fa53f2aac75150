"""Retrieval on a corpus of a few notes: what must be found and what must not."""

import pytest
from pyspark.sql import functions as F

from lorewright.functions import numbers as N
from lorewright.functions import text as X
from lorewright.operators import search as S

NOW = 1_700_000_000_000
NOTES = [
    ("n1", "Backup schedule", "The server snapshot runs every night.", ["ops"], None, None),
    ("n2", "Cooking pasta", "Boil water with salt, add spaghetti.", ["food"], None, None),
    ("n3", "Old invoice rule", "Invoices were paid within ten days.", ["money"], NOW - 10, None),
    ("n4", "Invoice rule", "Invoices are paid within thirty days.", ["money"], None, None),
    ("n5", "Deleted note", "snapshot snapshot snapshot", ["ops"], None, NOW),
]


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(i, "local", "semantic", t, c, tags, 1.0, None, valid_to, None, NOW - 1000, NOW - 1000, deleted, None, 0, 0.5) for i, t, c, tags, valid_to, deleted in NOTES]
    schema = "id string, scope string, type string, title string, content string, tags array<string>, confidence double, valid_from long, valid_to long, superseded_by string, created_at long, updated_at long, deleted_at long, last_access_at long, access_count long, utility double"
    return spark.createDataFrame(rows, schema).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_german_question_finds_english_note(notes):
    found = ids(S.search(notes, S.Search(query="Wie oft wird gesichert?", now_ms=NOW)))
    assert found[0] == "n1" and "n2" not in found


def test_stop_words_find_nothing_but_are_kept_alone(notes):
    assert S.content_terms("what do I cook with pasta") == ["cook", "pasta"]
    assert S.content_terms("the and") == ["the", "and"]


def test_deleted_notes_never_appear(notes):
    assert "n5" not in ids(S.search(notes, S.Search(query="snapshot", now_ms=NOW)))


def test_expired_notes_rank_lower_now_and_stand_alone_then(notes):
    now = S.search(notes, S.Search(query="invoices paid", now_ms=NOW)).collect()
    assert [r.id for r in now] == ["n4", "n3"] and [r.expired for r in now] == [False, True]
    then = S.search(notes, S.Search(query="invoices paid", as_of=NOW, now_ms=0)).collect()
    assert [r.id for r in then] == ["n4"] and not then[0].expired


def test_filters_come_after_ranking_and_total_before_the_page(notes):
    page = S.search(notes, S.Search(query="invoices paid", now_ms=NOW, limit=1, offset=1)).collect()
    assert [r.id for r in page] == ["n3"] and page[0].total == 2
    assert ids(S.search(notes, S.Search(query="invoices paid", tags=("food",), now_ms=NOW))) == []


def test_empty_query_lists_the_newest(notes):
    assert len(ids(S.search(notes, S.Search(query="", now_ms=NOW, limit=3)))) == 3


def test_concept_leg_and_its_switch(spark, notes):
    m = spark.createDataFrame([("n2", "red widget")], "memory_id string, entity string")
    assert "n2" in ids(S.search(notes, S.Search(query="a red widget", now_ms=NOW), mentions=m))
    assert ids(S.search(notes, S.Search(query="a red widget", now_ms=NOW, legs=frozenset({"bm25"})), mentions=m)) == []


def test_weak_vectors_have_no_vote_beside_words(spark, notes):
    chunks = spark.createDataFrame([("n2", 0, [1.0, 0.0], "m0"), ("n1", 0, [0.1, 1.0], "m0")], "memory_id string, seq int, embedding array<double>, model string")
    weak = S.search(notes, S.Search(query="snapshot", now_ms=NOW), chunks=chunks, query_vector=[1.0, 2.0])
    strong = S.search(notes, S.Search(query="snapshot", now_ms=NOW), chunks=chunks, query_vector=[1.0, 0.0])
    assert ids(weak)[0] == "n1" and "n2" in ids(strong)


def test_rerank_is_between_zero_and_one_and_null_without_terms(notes):
    rows = notes.select("id", S.rerank("backup schedule", F.col("title"), F.col("content"), F.col("tags")).alias("r"), S.rerank("?", F.col("title"), F.col("content"), F.col("tags")).alias("n"))
    got = {r.id: (r.r, r.n) for r in rows.collect()}
    assert got["n1"][0] > got["n2"][0] >= 0 and got["n1"][0] <= 1 and got["n1"][1] is None


def test_empty_table_is_searched(notes):
    assert ids(S.search(notes.limit(0), S.Search(query="snapshot", now_ms=NOW))) == []
    assert S.hybrid(notes.limit(0), "snapshot").count() == 0


def test_synonyms_are_not_chained_or_doubled():
    assert S.expand_query("backup snapshot") == "backup snapshot gesichert sicherung momentaufnahme"
    assert S.expand_query("private") == "private"


def test_query_pieces_have_words_first():
    assert S.query_pieces("the red widget")[:5] == ["the", "red", "widget", "the red", "red widget"]


def test_packing_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, "a", 50), (2, "b", 80), (3, "c", 30)], "rank int, id string, tokens long")
    assert [r.id for r in S.pack(hits, 90).orderBy("pos").collect()] == ["a", "c"]
    assert [r.id for r in S.pack(hits, 10).collect()] == ["a"]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "x", 1), ("q", "a", 2)], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "a", "k"), ("p", "b", "k")], "query_id string, id string, category string")
    r = S.metrics(hits, relevant).first()
    assert (r.hit_at_1, r.recall_at_5, r.mrr, r.queries) == (0.0, 0.5, 0.25, 2)


def test_time_questions():
    assert S.time_questions("When did I buy the bike and when did I sell the car?") and S.time_questions("What is a bike?") == []


@pytest.mark.parametrize(("text", "number"), [("1.200", "1200"), ("1,200", "1200"), ("12,50", "12.5"), ("1.200,25", "1200.25"), ("1'000", "1000"), ("abc", "abc")])
def test_plain_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "c string").select(N.plain_number(F.col("c"))).first()[0] == number


def test_checks(spark):
    row = spark.createDataFrame([("DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "4111 1111 1111 1111")], "a string, b string, c string")
    assert row.select(N.iban(F.col("a")), N.iban(F.col("b")), N.luhn(F.col("c"))).first()[:] == (True, False, True)


def test_chunks_hold_everything_and_stay_short(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    for text in (long, "a\n\nb", "", None, "x" * 3000):
        got = spark.createDataFrame([(text,)], "c string").select(X.chunk_text(F.col("c"))).first()[0]
        assert all(w in " ".join(got) for w in (text or "").split()) and (text == "x" * 3000 or all(len(c) <= 1200 for c in got))


def test_concepts_skip_fences_and_sentences(spark):
    text = "# Project Alpha\n```\n# hidden name\n```\nsee [[Beta Plan|b]] and [[Overview]]\n## this is a long sentence that ends."
    assert spark.createDataFrame([(text,)], "c string").select(X.concepts(F.col("c"))).first()[0] == ["project alpha", "beta plan"]
