"""The first notes of many queries, against the scores of all pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorewright.operators import batchsearch as T
from lorewright.operators import search as S
from lorewright.operators.index import WordIndex


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Notes with some copies and some deleted ones, of a few words that are very frequent and others that are not."""
    random.seed(5)
    words = [f"w{min(int(random.paretovariate(0.6)), 60)}" for _ in range(400)]
    rows = [(f"d{i}", "", " ".join(random.choices(words, k=random.randint(0, 30))) if i % 9 else "w1 w2 w3", ["x"], None if i % 17 else 1) for i in range(900)]
    notes = spark.createDataFrame(rows, "id string, title string, content string, tags array<string>, deleted_at long").repartition(5)
    return notes, WordIndex.keep(notes, str(tmp_path_factory.mktemp("index") / "i"))


def _queries(spark):
    random.seed(6)
    rows = [(f"q{i}", [f"W{min(int(random.paretovariate(0.6)), 70)}" for _ in range(random.randint(0, 6))]) for i in range(150)]
    return spark.createDataFrame(rows, "query_id string, terms array<string>")


def _first(found, most):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "id")
    rows = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).collect()
    return {(r.query_id, r["rank"], r.id, round(r.bm25, 9)) for r in rows}


@pytest.mark.parametrize("most", [1, 7, 2000])
def test_first_notes_of_queries_are_those_of_all_scores(spark, indexed, most, monkeypatch):
    monkeypatch.setattr(T, "QUERIES", 40)  # several chunks
    notes, index = indexed
    asked = _queries(spark)
    want = _first(S.bm25_of_queries(index, asked), most)
    assert len(want) > 100
    assert _first(T.bm25_top(index, asked, most), most) == want
    if most == 7:
        assert _first(T.bm25_top(WordIndex(notes), asked, most), most) == want


def test_pairs_of_queries_and_notes_are_no_rows(spark, indexed):
    _, index = indexed
    asked = spark.createDataFrame([(f"q{i}", ["w1", f"w{i}"]) for i in range(2, 30)], "query_id string, terms array<string>")
    every = S.bm25_of_queries(index, asked).count()
    assert every > 28 * 300
    assert T.bm25_top(index, asked, 5).count() < every / 5


def test_metrics_of_legs_do_not_score_all_pairs(spark, sf_dir, monkeypatch):
    from lorewright.plans import retrieval

    monkeypatch.setattr(S, "bm25_of_queries", lambda *_: pytest.fail("a row for each pair of query and note"))
    assert retrieval.ablation(spark, sf_dir).count() == 2


def test_queries_without_known_words_find_nothing(spark, indexed):
    asked = spark.createDataFrame([("q", ["nowhere"]), ("r", [])], "query_id string, terms array<string>")
    assert T.bm25_top(indexed[1], asked, 5).count() == 0
