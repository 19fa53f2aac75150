"""Kept indexes: deltas against fresh builds, cells against full scans."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lorewright.operators import cells, deltaindex
from lorewright.operators import search as S
from lorewright.operators.deltaindex import DeltaIndex, delta_index
from lorewright.operators.index import WordIndex
from lorewright.streaming.events import file_stream

CHANGE = "op string, id string, title string, content string, tags array<string>, deleted_at long, seq long"
WORDS = "alpha beta gamma delta épsilon zeta eta theta".split()


def some_changes(rng, seq, n):
    out = []
    for i in range(n):
        words = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))
        out.append((rng.choice(["put", "put", "drop"]), rng.choice([*(f"n{k}" for k in range(25)), None]), words[:9] or None, rng.choice([words, "", None]), rng.choice([[], ["alpha"]]), rng.choice([None, 5]), seq + i))
    return out


def now(changes):
    notes = {}
    for op, note, *rest in changes:
        if note is not None:
            notes.pop(note, None)
            if op == "put":
                notes[note] = (note, *rest[:4])
    return list(notes.values())


def answers(index, notes):
    scored = {r.id: (round(r.bm25, 9), r.matched) for r in S.bm25(notes, ["alpha", "epsilon", "absent"], index=index).collect()}
    return index.sizes, scored, sorted(index.all().select("term", "id", "length", "live", "tf").collect())


def test_deltas_are_a_fresh_build_at_every_batch(spark, tmp_path):
    rng, index, done = random.Random(2), DeltaIndex(spark, str(tmp_path / "index")), []
    assert answers(index, spark.createDataFrame([], CHANGE))[1:] == ({}, [])
    for batch in range(3):
        changes = some_changes(rng, 100 * batch, 30)
        df = spark.createDataFrame(changes, CHANGE)
        assert index.apply(batch, df)
        assert not index.apply(batch, df)
        done += changes
        notes = spark.createDataFrame(now(done), "id string, title string, content string, tags array<string>, deleted_at long")
        fresh = answers(WordIndex(notes), notes)
        assert answers(index, notes) == fresh
        if batch == 2:
            assert index.compact(2) > 0
            assert answers(index, notes) == fresh
            assert index.vacuum() > 0
            assert answers(index, notes) == fresh
    assert len(index.runs()) < 3
    index.apply(9, spark.createDataFrame([], CHANGE))
    assert answers(index, notes) == fresh


def test_a_batch_that_was_cut_off_leaves_nothing(spark, tmp_path):
    index = DeltaIndex(spark, str(tmp_path / "index"))
    index.apply(0, spark.createDataFrame([("put", "a", "alpha", "beta", [], None, 0)], CHANGE))
    (tmp_path / "index/runs/1-1/postings").mkdir(parents=True)
    assert index.lookup(["alpha"]).count() == 1
    assert index.apply(1, spark.createDataFrame([("put", "a", "gamma", "", [], None, 0)], CHANGE))
    assert index.lookup(["alpha"]).count() == 0
    assert index.sizes == (1.0, 1.0)


def test_a_lookup_reads_the_folders_of_its_terms(spark, tmp_path):
    index = DeltaIndex(spark, str(tmp_path / "index"))
    index.apply(0, spark.createDataFrame([("put", f"n{i}", f"word{i}", "alpha", [], None, 0) for i in range(300)], CHANGE))
    plan = index.lookup(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert index.lookup(["alpha"]).count() == 300


def test_a_stream_of_changes(spark, tmp_path):
    rng, done = random.Random(7), []
    for k in range(2):
        changes = some_changes(rng, 100 * k, 15)
        spark.createDataFrame(changes, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        delta_index(file_stream(spark, spark.createDataFrame([], CHANGE).schema, str(tmp_path / "in"), 100), str(tmp_path / "index"), str(tmp_path / "check"), fan=2)
        done += changes
    notes = spark.createDataFrame(now(done), "id string, title string, content string, tags array<string>, deleted_at long")
    index = DeltaIndex(spark, str(tmp_path / "index"))
    assert answers(index, notes) == answers(WordIndex(notes), notes)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_close_vectors_of_many_dimensions_meet_their_cluster_alone(spark):
    rng = np.random.default_rng(1)
    v = unit(unit(rng.normal(size=(150, 256)))[rng.integers(0, 150, 3000)] + 0.01 * rng.normal(size=(3000, 256)))
    df = spark.createDataFrame([(f"v{i:04d}", "m0", x.tolist()) for i, x in enumerate(v)], "id string, model string, c array<double>")
    cos = v @ v.T
    expected = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(cos >= 0.92, 1)), strict=True)}
    assert len(expected) > 10_000
    assert {(r.a, r.b) for r in cells.cosine_pairs(df, 0.92, 32).collect()} == expected
    blocks = cells.meetings(df, 0.92, 32).groupBy("model", "cell", "kind", "p", "q").pivot("side", [0, 1]).count().fillna(0).collect()
    compared = sum(b["0"] * (b["0"] - 1) // 2 if b.kind == 0 and b.p == b.q else b["0"] * b["1"] for b in blocks)
    print("share of pairs compared", compared / (3000 * 2999 / 2))
    assert compared < 0.012 * 3000 * 2999 / 2  # pairs of one cluster alone are 0.7 %


def test_a_center_with_no_row_and_a_block_with_none_do_no_harm(spark):
    v = np.repeat(np.eye(4), 9, axis=0)
    df = spark.createDataFrame([(f"v{i:02d}", "m0", x.tolist()) for i, x in enumerate(v)], "id string, model string, c array<double>")
    expected = {(f"v{i:02d}", f"v{j:02d}") for i in range(36) for j in range(i + 1, 36) if i // 9 == j // 9}
    for block in (1, 3, 100):
        got = [(r.a, r.b) for r in cells.cosine_pairs(df, 0.99, block).collect()]
        assert len(got) == len(expected)
        assert set(got) == expected


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_the_leg_of_cells_is_that_of_all_vectors(spark, tmp_path, spread):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 32))[rng.integers(0, 20, 1200)] + spread * rng.normal(size=(1200, 32))
    rows = [(f"n{i % 900}", i // 900, x.tolist(), f"m{i % 2}") for i, x in enumerate(v)]
    rows += [("zero", 0, [0.0] * 32, "m0"), ("none", 0, None, "m0")]
    chunks = spark.createDataFrame(rows, "memory_id string, seq int, embedding array<float>, model string")
    kept = cells.VectorCells.keep(chunks, str(tmp_path / "cells"), 16)
    live = spark.createDataFrame([(f"n{i}",) for i in range(0, 900, 3)], "id string")
    for query in (v[0], v[7] + v[9], -v[3], rng.normal(size=32)):
        for keep in (None, live):
            got, share = kept.leg(query.tolist(), "m0", keep)
            expected = S.vector_leg(chunks, query.tolist(), "m0", keep).where("similarity IS NOT NULL")
            assert sorted((r.id, round(r.similarity, 9)) for r in got.collect()) == sorted((r.id, round(r.similarity, 9)) for r in expected.collect())
    got, share = kept.leg(v[0].tolist(), "m0")
    assert share < 0.2 if spread < 1 else share <= 1
    assert kept.leg([0.0] * 32, "m0")[0].count() == S.vector_leg(chunks, [0.0] * 32, "m0").where("similarity IS NOT NULL").count()
    assert kept.leg([1.0] * 32, "absent")[0].count() == 0


def test_posting_lists_are_cut_by_tokens_and_hold_every_note(monkeypatch):
    monkeypatch.setattr(deltaindex, "FLUSH", 3)
    notes = [("a", True, ["x", "y", "x"]), ("b", False, []), ("c", True, None), ("d", True, ["y"]), ("e", True, ["z", "x"])]
    schema = pa.schema([("id", pa.string()), ("live", pa.bool_()), ("tokens", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, n, strict=True))], schema) for n in notes]
    found = list(deltaindex._counted(iter(batches)))
    lists = [r for b in found for r in b.to_pylist()]
    blocks = {r["block"]: list(zip(r["ids"], r["lengths"], r["lives"], r["tfs"], strict=True)) for r in lists if r["term"] is None}
    assert len(blocks) == 2
    rows = [(None, *p) for block in blocks.values() for p in block]
    rows += [(r["term"], *blocks[r["block"]][place][:3], tf) for r in lists if r["term"] is not None for place, tf in zip(r["places"], r["tfs"], strict=True)]
    assert sorted(r for r in rows if r[0]) == [("x", "a", 3, True, 2), ("x", "e", 2, True, 1), ("y", "a", 3, True, 1), ("y", "d", 1, True, 1), ("z", "e", 2, True, 1)]
    assert sorted((r[1], r[2], r[4]) for r in rows if r[0] is None) == [("a", 3, 2), ("b", 0, 0), ("c", None, 0), ("d", 1, 1), ("e", 2, 2)]
    assert list(deltaindex._counted(iter([]))) == []
