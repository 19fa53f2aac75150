"""Operators that meet their pairs by an index, against plain versions that compare everything."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright import store
from lorewright.operators import contradict as K
from lorewright.operators import graph as G
from lorewright.operators import joins as J
from lorewright.operators import search as S
from lorewright.operators import similar as M
from lorewright.operators.index import WeightIndex, WordIndex
from lorewright.sources import imports as I

WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("rau", "sti", "ndo") for c in ("n", "ter", "les")]


def prose(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def notes(spark):
    rng = np.random.default_rng(3)
    texts = [prose(rng, int(n)) for n in rng.integers(20, 90, 60)]
    for t in list(texts[:15]):
        words = t.split()
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words, "extra"]), " ".join(words[: len(words) // 2])]
    long = prose(rng, 400).split()
    texts += [" ".join(w for j, w in enumerate(long) if j != i * 9) for i in range(20)] + ["and " * 30, "and " * 90, None, "", "short"]
    rows = [(f"n{i:03d}", None if t is None else t[:30], t, [("a", "b", "c")[i % 3], "x"], i, None if i % 13 else i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, title string, content string, tags array<string>, updated_at long, deleted_at long").cache()


def shingles(title, content):
    words = [w for w in re.split(r"[^\w]+|_", f"{title or ''} {content}".lower()) if len(w) > 1 or w.isdigit()]
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


def test_near_links_are_those_of_all_pairs(notes):
    rows = [(r.id, len(r.content), frozenset(shingles(r.title, r.content))) for r in notes.collect() if r.content and len(r.content) >= 80]
    classes = {}
    for i, n, s in sorted(rows):
        classes.setdefault((n, s), i)
    expected = {(classes[n, s], i) for i, n, s in rows if classes[n, s] != i}
    firsts = [(i, n, s) for (n, s), i in classes.items()]
    for x, (i, n, s) in enumerate(firsts):
        for j, m, t in firsts[:x]:
            if min(n, m) / max(n, m) >= 0.5 and len(s & t) / len(s | t) > 0.85:
                expected.add((min(i, j), max(i, j)))
    got = {(r.a, r.b) for r in M.near_content(notes).collect()}
    assert got == expected and len(got) > 100


@pytest.mark.parametrize("largest", [1, 3, 12, 1000])
def test_near_links_of_small_chains_are_those_of_all_near_links(notes, largest):
    links = [(r.a, r.b) for r in M.near_content(notes).collect()]
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    size = Counter(map(top, root))
    expected = {(a, b) for a, b in links if size[top(a)] <= largest}
    assert {(r.a, r.b) for r in M.near_in_small_chains(notes, largest=largest).collect()} == expected


def test_a_family_of_near_copies_is_settled_by_few_comparisons(spark):
    words = [f"word{i}" for i in range(80)]
    rows = [(f"n{i:04d}", "t", " ".join(words[: i % 80] + [f"other{i}"] + words[i % 80 + 1 :])) for i in range(1500)]
    rows += [(f"p{i}", "t", " ".join([f"far{j}" for j in range(50)] + [f"end{i}"])) for i in range(3)]
    family = spark.createDataFrame(rows, "id string, title string, content string")
    classes = M._Classes.of(family, 0.85)
    assert classes.verified(classes.stars()).count() < 20 * 1500  # all pairs: 1.1 million
    assert {(r.a, r.b) for r in M.near_in_small_chains(family).collect()} == {("p0", "p1"), ("p0", "p2"), ("p1", "p2")}


def test_title_pairs_are_those_of_all_pairs(notes):
    rows = [(r.id, {w for w in re.split(r"[^A-Za-z0-9_]+", (r.title or "").lower()) if len(w) > 2}, set(r.tags)) for r in notes.collect()]
    for least in (0.5, 0.85, 1.0):
        expected = {(i, j) for i, s, t in rows for j, u, v in rows if i < j and s and u and len(s & u) / min(len(s), len(u)) >= least and len(t & v) / len(t | v) >= 0.5}
        assert {(r.a, r.b) for r in M.title_tag_pairs(notes, least).collect()} == expected


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("threshold", [0.92, 0.5])
def test_close_vectors_are_those_of_all_pairs(spark, block, threshold):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(70, 6)), np.repeat(rng.normal(size=(4, 6)), 12, axis=0) + rng.normal(size=(48, 6)) * 0.1])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"v{i:03d}", f"m{i % 2}", [float(x) for x in c]) for i, c in enumerate(v)]
    got = {(r.a, r.b, r.model): r.cosine for r in M.cosine_pairs(spark.createDataFrame(rows, "id string, model string, c array<double>"), threshold, block).collect()}
    cos = v @ v.T
    expected = {(f"v{i:03d}", f"v{j:03d}", f"m{i % 2}"): cos[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if i % 2 == j % 2 and cos[i, j] >= threshold}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert M.cosine_pairs(spark.createDataFrame([], "id string, model string, c array<double>")).count() == 0


def test_centroids_are_means(spark):
    rows = [("a", "m0", [1.0, 0.0]), ("a", "m0", [0.0, 1.0]), ("a", "m1", [9.0, 9.0]), ("b", "m1", [0.0, 0.0])]
    got = M.centroids(spark.createDataFrame(rows, "memory_id string, model string, embedding array<float>")).collect()
    assert [(r.id, r.model) for r in got] == [("a", "m0")] and np.allclose(got[0].c, [0.5**0.5] * 2)


def test_kept_indexes_answer_like_unkept_ones(spark, notes, tmp_path):
    kept = WordIndex.keep(notes, str(tmp_path / "w"))
    assert kept.sizes == WordIndex(notes).sizes
    for terms in (["baraun", "kestiter"], ["nowhere"], ["a", "x", "londoles"]):
        one, two = ({(r.id, round(r.bm25, 9), r.matched) for r in S.bm25(notes, terms, index=i).collect()} for i in (kept, None))
        assert one == two
    asked = spark.createDataFrame([("q", ["baraun", "kestiter"]), ("p", ["nowhere"])], "query_id string, terms array<string>")
    many = {(r.id, round(r.bm25, 9)) for r in S.bm25_of_queries(kept, asked).collect()}
    assert many == {(r.id, round(r.bm25, 9)) for r in S.bm25(notes, ["baraun", "kestiter"], index=kept).collect()}
    weights = WeightIndex.keep(notes, str(tmp_path / "t"))
    for query in ("baraun lorauter", "nowhere"):
        one, two = ([(r.id, round(r.score, 9)) for r in S.hybrid(notes, query, top_k=9, index=i).collect()] for i in (weights, None))
        assert one == two


def test_ranks_in_parts_are_ranks(spark):
    rows = spark.createDataFrame([(f"d{i}",) for i in range(300)], "id string")
    plain, parted = ({r.id: r["rank"] for r in S.ranked(rows, "x", F.col("id"), part=p).collect()} for p in (None, F.substring("id", 1, 2)))
    assert plain == parted


def test_hot_keys_join_like_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).where("k != 3")
    got = J.join_counted(rows, side, ["k"], 5000)
    assert got.columns == ["k", "id", "m"] and sorted(got.collect()) == sorted(rows.join(side.drop("n"), "k").collect())


def test_hubs_do_not_change_components(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(399, 2000), (5, 5), (None, None)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame([e for e in edges if None not in e], "a long, b long")).collect()}
    assert len(got) == 401 + 41 and {got[i] for i in [*range(400), 2000]} == {0} and {got[1000 + i] for i in range(41)} == {1000}


def test_a_window_bounds_communities(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a long, b long, w double")
    assert G.communities(edges).count() == 4
    with pytest.raises(ValueError, match="edges"):
        G.communities(edges, most=2)


def test_long_conversations_are_walked_to_their_root(spark):
    n = 2600
    messages = spark.createDataFrame([("c", f"m{i}", f"m{i - 1}" if i else None, "user", str(i)) for i in range(n)], "conv_id string, id string, parent string, role string, text string")
    got = I.active_branch(messages, spark.createDataFrame([("c", f"m{n - 1}")], "conv_id string, current string"))
    assert got.count() == n and got.where("cast(text AS int) != turn").count() == 0


def test_comparable_notes(spark):
    rows = [("a", "t", "semantic", None, None, 1), ("b", "t — 2/5", "semantic", None, None, 2), ("c", "t — 1/1", "procedural", None, None, 3), ("d", "t", "episodic", None, None, 4), ("e", "t", "semantic", "x", None, 5), ("f", "t", "semantic", None, 9, 6)]
    df = spark.createDataFrame(rows, "id string, title string, type string, superseded_by string, deleted_at long, updated_at long")
    assert [r.id for r in K.comparable(df, 10).collect()] == ["c", "a"] and K.comparable(df, 1).count() == 1


def test_a_cluster_without_a_shared_folder_is_told(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.scratch(Session)


FACTS = "id string, title string, updated_at long, source string, n int, sentence string, kind string, value string, norm string, in_sentence array<string>, stems array<string>"


def some_facts(rng, n, stems, most):
    out = []
    for i in range(n):
        held = sorted({f"s{min(int(rng.exponential(stems / 6)), stems - 1)}" for _ in range(rng.integers(2, most))})
        value = str(rng.integers(0, 6))
        if len(held) > 1:
            out.append((f"n{i // 2}", "t", i, (None, "u", "v")[i % 3], i % 2, f"{value} {' '.join(held)}", ("date", "money")[i % 5 == 0], value, value, [value], held))
    return out


@pytest.mark.parametrize("posting", [None, 25])
@pytest.mark.parametrize("block", [2048, 5])
def test_contradictions_are_those_of_all_pairs(spark, posting, block):
    rows = some_facts(np.random.default_rng(5), 240, 40, 9)
    common = Counter((r[6], s) for r in rows for s in r[10])
    expected = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[6] == y[6] and x[8] != y[8] and (x[3] is None or x[3] != y[3]):
                shared = [s for s in set(x[10]) & set(y[10]) if posting is None or common[x[6], s] <= posting]
                if len(shared) >= 2 and len(shared) >= 0.5 * min(len(x[10]), len(y[10])):
                    expected.add(f"{x[0]}|{y[0]}")
    got = [r.key for r in K.contradictions(spark.createDataFrame(rows, FACTS), limit=None, posting=posting, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(got) > 50


def test_facts_about_a_subject_of_thousands_meet(spark):
    rows = [(f"n{i:04d}", "t", i, None, 0, f"s{i}", "date", "1", "1", ["1"], ["common", f"only{i}", f"more{i}"]) for i in range(5000)]
    rows += [(f"z{i}", "t", i, None, 0, f"z{i}", "date", str(i), str(i), [str(i)], ["common", "rare"]) for i in range(2, 5)]
    rows += [("w", "t", 0, None, 0, "w", "date", "7", "7", ["7"], ["common", "only77", "other", "words"])]
    got = {r.key for r in K.contradictions(spark.createDataFrame(rows, FACTS), limit=None).collect()}
    assert got == {"z2|z3", "z2|z4", "z3|z4", "n0077|w"}
    assert "n0077|w" not in {r.key for r in K.contradictions(spark.createDataFrame(rows, FACTS), limit=None, posting=400).collect()}
