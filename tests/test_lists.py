"""Kept indexes hold lists of postings, not a row for each posting."""

from lorewright.operators import search as S
from lorewright.operators import similar as M
from lorewright.operators.index import WeightIndex, WordIndex

TEXTS = [f"red widget number{i % 7} " * (1 + i % 3) for i in range(200)] + ["", None]


def test_kept_indexes_hold_a_list_for_each_term_of_a_block(spark, tmp_path):
    rows = [(f"d{i:03d}", "title", t, ["en"], i, None) for i, t in enumerate(TEXTS)]
    notes = spark.createDataFrame(rows, "id string, title string, content string, tags array<string>, updated_at long, deleted_at long").coalesce(1)
    WordIndex.keep(notes, str(tmp_path / "w"))
    weights = WeightIndex.keep(notes, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "w" / "postings")).count() == 11 + 1  # terms, and the block itself
    assert spark.read.parquet(str(tmp_path / "t" / "terms")).count() == 11 + 1
    assert weights.docs.count() == len(TEXTS) and weights.sizes[0] == len(TEXTS)
    answer = lambda index: [(r.id, round(r.score, 9)) for r in S.hybrid(notes, "red number3", index=index).collect()]
    assert answer(weights) == answer(None)


def test_title_pairs_of_copies_and_of_a_frequent_word(spark, monkeypatch):
    """Copies are compared once, and only pairs that agree leave the join, whose frequent words are dealt into parts."""
    monkeypatch.setattr(M, "TITLES", 3)
    titles = ["the red widget"] * 30 + [f"the blue{i} thing{i % 4}" for i in range(40)] + ["the", "", None]
    rows = [(f"d{i:03d}", t, [] if i == 5 else [("en", "de")[i % 2], "x"]) for i, t in enumerate(titles)]
    notes = spark.createDataFrame(rows, "id string, title string, tags array<string>")
    sets = [(i, {w for w in (t or "").split() if len(w) > 2}, set(g)) for i, t, g in rows]
    expected = {(i, j) for i, s, t in sets for j, u, v in sets if i < j and s and u and len(s & u) / min(len(s), len(u)) >= 0.6 and (not t or not v or len(t & v) / len(t | v) >= 0.5)}
    got = [(r.a, r.b) for r in M.title_tag_pairs(notes, 0.6).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert M._title_links(M._titles(notes), 0.6, 0.5).count() < 400  # classes, not the pairs of their copies
