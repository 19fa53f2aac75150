"""Similarity, contradictions, graph, lifecycle and governance on a few rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lorewright.functions import classify as C
from lorewright.operators import contradict as K
from lorewright.operators import filters as L
from lorewright.operators import graph as G
from lorewright.operators import lifecycle as D
from lorewright.operators import secure as Q
from lorewright.operators import similar as M
from lorewright.plans import graphs as P
from lorewright.sources import imports as I


def test_components_of_a_long_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert M.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_need_the_words_in_order(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [("a", "t", " ".join(words), 1), ("b", "t", " ".join(words[:-1] + ["other"]), 2), ("c", "t", " ".join(reversed(words)), 3)]
    notes = spark.createDataFrame(rows, "id string, title string, content string, updated_at long")
    assert [(r.a, r.b) for r in M.near_content(notes).collect()] == [("a", "b")]
    assert M.near_content(notes, dismissed=spark.createDataFrame([("b", "a")], "a string, b string")).count() == 0
    groups = M.duplicate_groups(notes).collect()
    assert {r.id for r in groups} == {"a", "b", "c"} and {r.reason for r in groups} == {"identical-title"}


def test_cosine_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    vectors = np.concatenate([base, base + rng.normal(scale=0.15, size=base.shape)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"{i:03d}", "m", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, model string, c array<double>")
    near = vectors @ vectors.T
    for threshold in (0.5, 0.92):
        expected = {(f"{i:03d}", f"{j:03d}") for i in range(120) for j in range(i + 1, 120) if near[i, j] >= threshold}
        assert {(r.a, r.b) for r in M.cosine_pairs(df, threshold).collect()} == expected


def test_consolidation_counts_only_live_notes(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3)], "keep_id string, duplicate_id string, n int")
    assert sorted((r.keep_id, r.duplicate_id) for r in M.apply_consolidation(rows).collect()) == [("a", "b"), ("c", "d")]


def test_contradictions(spark):
    rows = [
        ("a", "Backup", "The nightly backup of the office starts at 02:00 every day.", 1),
        ("b", "Backup", "The nightly backup of the office starts at 03:30 every day.", 2),
        ("c", "Same", "The nightly backup of the office starts at 2:00 every day.", 3),
        ("d", "Other", "Lunch in the canteen starts at 12:00 on Mondays.", 4),
        ("e", "Range", "The nightly backup of the office takes 2 to 4 hours every day.", 5),
        ("f", "Longer", "The nightly backup of the office takes 9 hours every day.", 6),
    ]
    notes = spark.createDataFrame(rows, "id string, title string, content string, updated_at long").withColumns({"type": F.lit("semantic"), "superseded_by": F.lit(None).cast("string"), "deleted_at": F.lit(None).cast("long")})
    facts = K.facts(notes)
    assert {r.key for r in K.contradictions(facts).collect()} == {"a|b", "b|c"}
    assert K.contradictions(facts, spark.createDataFrame([("b", "a")], "a string, b string")).count() == 1
    assert facts.where("id = 'e'").count() == 0  # the 4 hours end a range


def test_facts_late_in_a_long_text_are_found(spark):
    late = "Nothing of note was said here. " * 400
    rows = [("a", "Backup", late + "The nightly backup of the office starts at 02:00 every day.", 1), ("b", "Backup", "The nightly backup of the office starts at 03:30 every day.", 2)]
    notes = spark.createDataFrame(rows, "id string, title string, content string, updated_at long").withColumns({"type": F.lit("semantic"), "superseded_by": F.lit(None).cast("string"), "deleted_at": F.lit(None).cast("long")})
    assert [r.key for r in K.contradictions(K.facts(notes)).collect()] == ["a|b"]


def test_louvain_finds_cliques_and_q_is_that_of_the_formula(spark):
    edges = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    w = spark.createDataFrame(edges, "a string, b string, w double")
    part = G.communities(w)
    got = {r.node: r.community for r in part.collect()}
    assert len(set(got.values())) == 3 and all(got[f"{c}{i}"] == got[f"{c}0"] for c in "abc" for i in range(5))
    m = len(edges)
    expected = sum(10 / m - (k / (2 * m)) ** 2 for k in (21, 22, 21))
    assert abs(G.modularity(w, part).first().q - expected) < 1e-9
    assert {r.node for r in G.propagate(w, 5).collect()} == set(got)


def _all_pairs(sf_dir):
    """Weights of all pairs of parts in one order: 1, and 2 more where the smaller key is even."""
    items = pd.read_parquet(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).drop_duplicates()
    pairs = items.merge(items, on="l_orderkey")
    pairs = pairs[pairs.l_partkey_x < pairs.l_partkey_y][["l_partkey_x", "l_partkey_y"]].drop_duplicates()
    return {(int(a), int(b)): 3.0 if a % 2 == 0 else 1.0 for a, b in pairs.itertuples(index=False)}


def test_propagation_sees_all_pairs(spark, sf_dir):
    weights = _all_pairs(sf_dir)
    near = {}
    for (a, b), w in weights.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for _ in range(5):
        votes = {n: {label[n]: 0.5} for n in near}
        for n, others in near.items():
            for m, w in others:
                votes[n][label[m]] = votes[n].get(label[m], 0.0) + w
        label = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
    assert len(weights) > 400 and {r.node: r.community for r in P.gra_propagation(spark, sf_dir).collect()} == label


def test_louvain_sees_all_edges_of_the_window(spark, sf_dir):
    weights = _all_pairs(sf_dir)
    drawn = {int(r.entity) for r in P._drawn(spark, sf_dir).collect()}
    inside = [(str(a), str(b), w) for (a, b), w in weights.items() if a in drawn and b in drawn]
    got = {}
    for r in P.gra_louvain(spark, sf_dir).collect():
        got.setdefault(r.community, set()).add(r.node)
    assert set().union(*got.values()) == {x for a, b, _ in inside for x in (a, b)}
    expected = {}
    for node, c in G._louvain(inside).items():
        expected.setdefault(c, set()).add(node)
    assert len(inside) > 400 and sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_khop_and_subgraph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    near = G.khop(e, spark.createDataFrame([("c",)], "node string"), 2)
    assert {(r.node, r.distance) for r in near.collect()} == {("c", 0), ("b", 1), ("d", 1), ("a", 2)}
    assert G.subgraph(e, near.where("distance <= 1")).count() == 2


def test_semantic_map_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{i}", 0, [float(x) for x in rng.normal(size=6)], "m") for i in range(30)]
    schema = "memory_id string, seq int, embedding array<double>, model string"
    one = G.semantic_map(spark.createDataFrame(rows, schema)).orderBy("id").toPandas()
    two = G.semantic_map(spark.createDataFrame(rows[::-1], schema)).orderBy("id").toPandas()
    assert np.allclose(one[["x", "y"]], two[["x", "y"]]) and one.share_x[0] >= one.share_y[0]


def test_claims_are_checked(spark):
    text = '{"beziehungen":[{"quelle":"Ann","ziel":"Acme","wort":"works at"},{"quelle":"x","ziel":"x","wort":"is"},{"quelle":"a","ziel":"b","wort":"mentions"},{"quelle":"","ziel":"b","wort":"k"}]}'
    rows = spark.createDataFrame([(text,), ("broken",), (None,)], "c string").select(G.valid_claims(F.col("c")).alias("v")).collect()
    assert [tuple(c) for c in rows[0].v] == [("ann", "acme", "works at")] and rows[1].v == [] and rows[2].v == []


def test_merge_adds_and_keeps_nulls_out(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, title string, n int")
    out = D.merge(table, spark.createDataFrame([("a", None), ("c", "z")], "id string, title string"), ["title"])
    assert {tuple(r) for r in out.collect()} == {("a", "x", 1), ("b", "y", 2), ("c", "z", None)}


def test_reinforcement_clamps_after_each_step(spark):
    table = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, utility double")
    log = spark.createDataFrame([("a", 2, -0.5), ("a", 1, 0.5)], "id string, n int, delta double")
    assert {r.id: r.utility for r in D.reinforce(table, log).collect()} == {"a": 0.5, "b": 0.5}


def test_write_gate_adds_unless_told(spark):
    new = spark.createDataFrame([("a",), ("b",)], "id string")
    near = spark.createDataFrame([("a", "z", 0.95)], "id string, other string, cosine double")
    assert {r.id: r.decision for r in D.write_gate(new, near).collect()} == {"a": "ADD", "b": "ADD"}
    assert {r.id: r.decision for r in D.write_gate(new, near, F.lit("noop")).collect()} == {"a": "NOOP", "b": "ADD"}


def test_note_types(spark):
    rows = [("How to", "- a\n- b\n- c", [], None), ("x", "1. a\n2. b\n3. c", [], None), ("Meeting", "", [], None), ("Log 2024-05-01", "", [], None), ("x", "<a href='x'>y</a>", [], None), ("x", "", ["machine-scan"], None), ("x", "words", [], "a.PDF"), ("x", "words", [], None)]
    df = spark.createDataFrame(rows, "t string, c string, g array<string>, s string")
    kinds = [r[0].type for r in df.select(C.note_type(F.col("t"), F.col("c"), F.col("g"), F.col("s"))).collect()]
    assert kinds == ["procedural", "procedural", "episodic", "episodic", "reference", "reference", "reference", "semantic"]


def test_topics_end_at_word_edges(spark):
    df = spark.createDataFrame([("todo: call",), ("mistodone",), ("https://x.y",)], "c string")
    assert [r[0] for r in df.select(C.topics(F.lit(""), F.col("c"), F.lit("notes"))).collect()] == [["tasks"], [], ["links"]]


def test_personal_data_is_found_and_put_back():
    text = "Mail ann@example.org or ann@example.org, IBAN DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1111, on 01.02.2026; password: hunter22"
    kinds = [f[0] for f in Q.find(text)]
    assert kinds == ["email", "email", "iban", "card", "secret"]
    hidden, names = Q.pseudonyms(text)
    assert "example.org" not in hidden and hidden.count("[EMAIL-1]") == 2 and Q.restore(hidden, names) == text
    assert Q.find(None) == [] and Q.pseudonyms("")[0] == ""


def test_masks(spark):
    key = "sk-ant-" + "a" * 20
    df = spark.createDataFrame([(f"key {key} and {key} end",), ("nothing",)], "c string")
    assert [r[0] for r in df.select(Q.mask(F.col("c"))).collect()] == ["key sk-ant-…MASKIERT(27) and sk-ant-…MASKIERT(27) end", "nothing"]


def test_a_changed_entry_breaks_its_chain(spark):
    log = pd.DataFrame({"id": range(10), "at": range(10), "actor": ["x"] * 10, "action": ["a"] * 10, "target": [None] * 9 + ['q"\\'], "detail": ["d"] * 10})
    sealed = Q.chain(spark.createDataFrame(log, "id long, at long, actor string, action string, target string, detail string"))
    assert Q.verify(sealed).first().broken_at is None
    bent = sealed.withColumn("detail", F.when(F.col("id") == 4, "e").otherwise(F.col("detail")))
    assert Q.verify(bent).first().broken_at == 4
    assert Q.verify(sealed.where("id <> 5")).first().broken_at == 6
    heads = sealed.groupBy("actor").agg(F.count("*").alias("entries"), F.max_by("hash", "id").alias("hash"))
    short = sealed.where("id < 9")
    assert Q.against_head(Q.verify(short), short, heads).first().truncated


def test_addresses():
    assert all(Q.private_address(h) for h in ("127.0.0.1", "localhost", "10.0.0.8", "::1", "::ffff:10.0.0.1", "2130706433", "0x7f000001", None, "a.internal"))
    assert not any(Q.private_address(h) for h in ("8.8.8.8", "example.org"))


def test_encryption_needs_the_key(spark):
    key = Q.bundle_key("open", b"salt")
    row = spark.createDataFrame([("hello",)], "c string").select(Q.encrypted(F.col("c"), key).alias("b"))
    assert row.select(Q.decrypted(F.col("b"), key)).first()[0] == "hello"


def test_verdicts(spark):
    rows = [("/u/.ssh/a.md", 5), ("/u/.env", 5), ("/u/node_modules/a.md", 5), ("/u/.a.md", 5), ("/u/a.exe", 5), ("/u/a.md", 10**9), ("/u/a.md", 0), ("/u/a.md", 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, n long").select(L.verdict(F.col("p"), F.col("n"))).collect()]
    assert got == ["secret", "secret", "system folder", "hidden", "format", "too big", "empty", None]


def test_front_matter():
    fields, rows, body = I.parse_front_matter('---\ntitle: "A: b"\ntags: [x, "y"]\nlist:\n  - one\n  - two\nconfidence: 0.5\n---\n\nText\n--- not\n')
    assert fields == {"title": "A: b", "confidence": "0.5"} and rows == {"tags": ["x", "y"], "list": ["one", "two"]} and body == "\nText\n--- not\n"
    assert I.parse_front_matter("plain")[2] == "plain" and I.parse_front_matter(None) == ({}, {}, "")


def test_markdown_files_are_read(spark, tmp_path):
    (tmp_path / "one.md").write_text("---\ntitle: '{{title}}'\ncreated: 2024-01-02\n---\nBody [[Two]]")
    (tmp_path / "two.md").write_text("No head")
    notes = I.notes_of_markdown(I.read_markdown(spark, str(tmp_path)), 5).collect()
    assert {(r.title, r.content, r.created_at) for r in notes} == {("one", "Body [[Two]]", 1704153600000), ("two", "No head", 5)}


def test_chat_exports_follow_the_current_branch(spark):
    tree = '{"conversation_id":"c","current_node":"n3","mapping":{"n0":{"parent":null},"n1":{"parent":"n0","message":{"author":{"role":"user"},"content":{"parts":["first question"]}}},"n2":{"parent":"n1","message":{"author":{"role":"assistant"},"content":{"parts":["dead end"]}}},"n3":{"parent":"n1","message":{"author":{"role":"assistant"},"content":{"parts":["answer"]}}}}}'
    flat = '{"name":"x","chat_messages":[{"sender":"human","text":"hi there"},{"sender":"assistant","text":"hello"}]}'
    turns = I.chat_export(spark.createDataFrame([(tree,), (flat,)], "json string"))
    assert [r.text for r in turns.where("conv_id = 'c'").orderBy("turn").collect()] == ["first question", "answer"]
    assert I.conversation_notes(turns).count() == 2


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.exe").write_bytes(b"\0\1")
    (tmp_path / ".ssh").mkdir()
    (tmp_path / ".ssh" / "c.md").write_text("key")
    assert [(r.text, r.size) for r in I.read_files(spark, str(tmp_path)).collect()] == [("hello", 5)]
