from pyspark.sql import functions as F

from lorewright import evalkit, extensions as X
from lorewright.operators.graph import fold_tree


def test_questions_are_answered(spark):
    got = {r.category: r for r in evalkit.evaluate(spark).collect()}
    assert got["lexical"].hit_at_1 == 1.0 and got["temporal"].hit_at_1 == 1.0
    assert got["paraphrase"].hit_at_1 == 1.0 and got["distractor"].recall_at_5 == 1.0


def test_model_answers():
    assert X.first_json('<think>{"a":1}</think> so: {"title":"abcdef","n":2} and {"x":1}', {"title": 3}) == {"title": "abc", "n": 2}
    assert X.first_json("no object {") is None and X.first_json(None) is None
    assert X.hypothetical_answers("q", lambda q: "1. The rent is due on Monday.\n2. Is it?\n3. It was paid in May.") == ["The rent is due on Monday.", "It was paid in May."]
    assert X.hypothetical_answers("q", lambda q: 1 / 0) == [] == X.hypothetical_answers("q", None)


def test_small_helpers():
    assert X.glyphs(["alpha", "Alps", "beta", "alpha beta"]) == {"alpha": "A", "Alps": "AL", "beta": "B", "alpha beta": "ALP"}
    assert X.as_millis("2024-01-01") == 1704067200000 == X.as_millis(1704067200000) and X.as_millis("soon") is None
    assert X.clamped("7", 1, 5, 2) == 5 and X.clamped(None, 1, 5, 2) == 2
    assert fold_tree({"a": 5, "b": 3}, 6) == {"a"} and fold_tree({"a": 1}, 6) == set()


def test_policies(spark):
    rows = spark.createDataFrame([("a", "private", "ann"), ("b", "private", "bo"), ("c", "local", "bo")], "id string, scope string, owner string")
    assert {r.id for r in X.Extensions(policy=X.ScopePolicy(), actor="ann").filtered(rows).collect()} == {"a", "c"}
    assert X.Extensions().filtered(rows).agg(F.count("*")).first()[0] == 3
