"""Periodic runs, packing and hard negatives against plain versions, and what odd input does to each."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorewright.llm import negatives, packing, periodic
from lorewright.llm.common import text_bytes

from ..oracle import connected, assert_same
from .test_llm import ODD, prose


@pytest.fixture
def documents(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, "doc_id long, text string, RUNS string, pieces int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


ROWS = [(i, t, "clash", i) for i, t in enumerate([*ODD, prose(2, 90), prose(2, 90), " ".join(["again"] * 400), " ".join((prose(5, 7) + " ").split() * 60)])]
ROWS += [(None, prose(3, 60), None, None), (7, prose(6, 40), "clash", 1), (7, prose(6, 40), "clash", 1)]
ROWS += [(i, prose(i, 20 + i), None, 0) for i in range(100, 180)]

# 11 periodic runs


def plain_runs(words, least=24, repeats=3):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, repeats * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng):
    out = []
    for _ in range(rng.randint(0, 4)):
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        kind = rng.random()
        if kind < 0.4:
            out += [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        elif kind < 0.8:
            out += ([rng.choice(letters) for _ in range(rng.randint(1, 15))] * 60)[: rng.randint(1, 60)]
        else:  # Fibonacci and Thue-Morse words
            rule, word = rng.choice([{"a": "ab", "b": "a"}, {"a": "ab", "b": "ba"}]), "a"
            for _ in range(rng.randint(1, 7)):
                word = "".join(rule[c] for c in word)
            out += word
    return out


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (1, 2), (10, 2), (7, 4)])
def test_runs_are_those_of_the_definition(least, repeats):
    rng = random.Random(least)
    for _ in range(15):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        ids, rows = periodic.number_words(*text_bytes(pa.array([" \t".join(t) for t in texts], pa.string())))
        expected = [(s + int(rows[i]), n, q) for i, t in enumerate(texts) for s, n, q in plain_runs(t, least, repeats)]
        assert [tuple(x) for x in periodic.runs_of_rows(ids, rows, least, repeats).tolist()] == expected


def test_overlap_is_least_over_all_periods():
    for least in range(1, 40):
        for repeats in range(2, 6):
            assert periodic.overlap(least, repeats) == min(max(least, repeats * q) - q for q in range(1, 200))


def test_runs_query(spark, documents):
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, documents(ROWS)).collect()), key=str)
    expected = []
    for doc_id, text, *_ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
        expected.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests))
    assert sum(x[1] > 0 for x in expected) > 5
    assert got == sorted(expected, key=str)


def test_runs_operator_keeps_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, RUNS string, pieces int")
    out = periodic.collapse_runs(df)
    assert out.columns == ["doc_id", "text", "pieces", "runs", "collapsed"]
    assert out.count() == len(ROWS)
    assert periodic.collapse_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="min_repeats"):
        periodic.collapse_runs(df, min_repeats=1)


# 12 packing


def public_ids():
    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_tokens_are_those_of_the_public_tokenizer():
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\xa0", " ", "é", "'s", "'", "'S", "1", "23", ".", "!!", "\x1c", "\x7f", "日", "<|endoftext|>", "don't", "\x85", "　"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500))]
    encode, exact = packing._Words(packing.VOCABULARY), public_ids()
    for some in (texts[:700], texts[600:], texts):
        ids, rows = packing.tokens_of(*text_bytes(pa.array(some, pa.string())), encode)
        assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == [exact(t) for t in some]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once_and_is_near_its_bound(seed):
    rng = np.random.default_rng(seed)
    drawn = [rng.integers(1, 2049, 300), rng.geometric(0.003, 4000).clip(1, 2048), np.full(50, 1025), rng.choice([700, 683, 682, 1365], 999), np.array([1]), rng.integers(200, 260, 500) * 4][seed]
    histogram = {int(k): int(n) for k, n in zip(*np.unique(drawn, return_counts=True), strict=True)}
    made = packing.plan(histogram)
    used = {}
    for filling, n in made.fillings:
        assert sum(length * a for length, a in filling) <= 2048
        for length, a in filling:
            used[length] = used.get(length, 0) + a * n
    assert used == histogram
    plain = []  # best-fit-decreasing
    for x in sorted(drawn.tolist(), reverse=True):
        room = min((r for r in plain if r >= x), default=None)
        if room is not None:
            plain.remove(room)
        plain.append((2048 if room is None else room) - x)
    assert made.bound <= made.sequences <= len(plain)
    assert made.sequences <= made.bound * 1.05 + 1


def test_packing_query(spark, documents):
    rows = [*ROWS, (500, prose(9, 9000), None, 1), (501, prose(10, 2500), None, 1)]
    got = packing.op12_packing(spark, documents(rows)).collect()
    exact, expected = public_ids(), []
    for doc_id, text, *_ in rows:
        ids, at, piece = [*exact(text), 0], 0, 0
        while at < len(ids):
            step = (len(ids) - at) % 2048 or 2048
            expected.append((doc_id, piece, at, step, zlib.crc32(np.array(ids[at : at + step], "<u4").tobytes())))
            at, piece = at + step, piece + 1
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for here in places.values():
        at = 0
        for offset, length in sorted(here):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1


def test_packing_takes_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# 13 hard negatives


def vectors(spark, path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score long").repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def clustered(n, width, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    x = centers[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), rng.integers(0, 4, n)


def test_negatives_query_on_clusters_copies_and_odd_rows(spark, tmp_path):
    x, label = clustered(3000, 16, 1)
    x[1000:2000] = x[0]  # a third of all rows are copies
    rows = [(i, v.tolist(), int(c), 1) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    rows += [(3000, None, 1, 1), (3100, [float("nan")] * 16, 1, 1), (3200, [None] * 16, 1, 1), (3300, x[0].tolist(), None, 1), (3400, [float("inf")] * 16, 1, 1), (3500, [0.0] * 16, 2, 1)]
    folder = vectors(spark, tmp_path, rows)
    assert_same(negatives.op13_hard_negatives(spark, folder), connected(folder), negatives.OP13_SQL)


def test_negatives_skip_clusters_by_their_bounds(spark, tmp_path):
    x, label = clustered(6000, 8, 2, 0.02)
    rows = negatives.whole_vectors(spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int"))
    lists, centers, radii = negatives.build_lists(rows)
    blocks = lists.collect()
    assert sum(len(b.ids) // 8 for b in blocks) == 6000
    for b in blocks:
        packed = np.frombuffer(b.vectors, b.vectors[:3].decode(), offset=3).reshape(-1, 8).astype(float)
        assert abs(np.sqrt(((packed - centers[b.cell]) ** 2).sum(1)).max() - b.radius) < 1e-6
        assert b.radius <= radii[b.cell]


def test_negatives_of_few_long_and_uneven_vectors(spark, tmp_path):
    rows = [(100 * i, [1000.0 * (i % 3), 3.5, 1e6 * i][: 1 + i % 3], i % 2, 0) for i in range(9)]
    frame = spark.createDataFrame([*rows, (None, [1.0], 1, 0), (900, [1e30], 1, 0)], "vec_id long, embedding array<double>, label int, score long")
    cut = negatives.whole_vectors(frame)
    assert cut.count() == 9
    got = {(r.anchor_id, r.positive_id, r["rank"]): (r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine_negatives(cut, cut.where("vec_id % 100 = 0")).collect()}
    v = {i: [int(np.floor(256 * c)) for c in e] for i, e, *_ in rows}
    kind = {i: c for i, _, c, _ in rows}
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=False))
    expected = {}
    for a in v:
        for p in sorted((i for i in v if i != a and kind[i] == kind[a]), key=lambda i: (-score(a, i), i))[:5]:
            good = [i for i in v if kind[i] != kind[a] and 30 * score(a, p) <= 100 * score(a, i) <= 90 * score(a, p)]
            for n, i in enumerate(sorted(good, key=lambda i: (-score(a, i), i))[:10], 1):
                expected[a, p, n] = (i, score(a, p), score(a, i))
    assert got == expected
    assert negatives.mine_negatives(cut.limit(0), cut.limit(0)).collect() == []
