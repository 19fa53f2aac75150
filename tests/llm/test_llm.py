"""The ten operators against plain versions, on fixtures with nulls, empty and long texts, ties, copies and odd columns."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewright.llm import common, decontaminate, golay, language, licenses, linear, media, mixing, neardup, quality, rollup, runindex, sharding, substrings

from ..oracle import assert_same, connected
from . import brute

SCHEMA = "doc_id long, text string"
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("rau", "sti", "ndo") for c in ("n", "ter", "les")]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


ODD = [None, "", " \n\t ", "x", "ä€😀", "A" * 5000, prose(1, 4000), "!!! ### $$$", "\x00\x01 control", "Groß UND klein"]


def rows_of(texts):
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def odd(spark):
    texts = ODD + [prose(2, 80), prose(2, 80), prose(2, 80) + " end"]
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts)] + [(None, "no id " + prose(3, 30), "clash", None), (3, "x", "clash", 0.0), (3, "x", "clash", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, SCORE string, size double")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 media


def test_media_round_trip(spark, odd):
    rows = media.wav_features(media.encode_wav(odd)).collect()
    assert len(rows) == odd.count() and rows[0].SCORE == "clash"
    for r in rows:
        data = (r.text or "").encode()
        payload = bytes(r.payload)
        assert payload[: len(data)] == data and not payload[len(data) :].strip(b"\0") and len(payload) == max(64, -(-len(data) // 64) * 64)
        assert media.from_wav(bytes(r.media)) == payload and r.n_bytes == len(data)
        assert sorted(r.fingerprint) == r.fingerprint
    same = {r.text: tuple(r.fingerprint) for r in rows}
    assert all(same[r.text] == tuple(r.fingerprint) for r in rows)
    assert media.wav_features(media.encode_wav(empty(spark))).count() == 0


def test_media_query_digests(spark, tmp_path):
    spark.createDataFrame(rows_of(ODD), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in media.op1_media(spark, str(tmp_path)).collect():
        data = (ODD[r.doc_id] or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_bytes == 44 + len(payload) == 44 + r.payload_bytes


def test_a_tone_has_its_peak_and_a_shifted_clip_shares_pairs():
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8)
    _, bins = media.peaks(tone)
    assert np.bincount(bins).argmax() == round(1000 / media.RATE * media.FRAME)
    noise = np.random.default_rng(0).integers(0, 256, 20_000).astype(np.uint8)
    pair = (1 << 19) - 1
    whole, part = media.fingerprint(noise), media.fingerprint(noise[media.HOP * 20 :])
    assert len({x & pair for x in part.tolist()} & {x & pair for x in whole.tolist()}) > 0.9 * len({x & pair for x in part.tolist()})


# 2 licenses


def test_licenses_are_found_with_their_spans_and_others_are_not(spark):
    mit = licenses.TEMPLATES["mit-permission"]
    words = mit.split()
    noisy = " ".join(words[:10] + ["oddly"] + words[10:20] + words[21:])
    texts = [f"{prose(4, 50)}. {mit}", prose(5, 300), f"{prose(6, 20)} {noisy} {prose(7, 20)}", "Released under the MIT License. " * 3, "under the MIT bridge", None, ""]
    found = {r.doc_id: [m.asDict() for m in r.licenses] for r in licenses.scan_licenses(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert [m["license"] for m in found[0]] == ["mit-permission"] and found[0][0]["coverage"] == 1.0 and found[0][0]["first_word"] == 50
    assert found[1] == found[4] == found[5] == found[6] == []
    assert [m["license"] for m in found[2]] == ["mit-permission"] and 0.9 < found[2][0]["coverage"] < 1
    assert [(m["first_word"], m["last_word"]) for m in found[3]] == [(0, 4), (5, 9), (10, 14)]


def test_alignment_is_the_longest_common_run_for_equal_words():
    assert licenses.align([1, 2, 3, 4], [9, 1, 2, 3, 4, 9], 1, 4) == (4, 1, 4)
    assert licenses.align([1, 2, 3, 4], [9, 1, 2, 7, 3, 4], 1, 4)[0] == 4
    assert licenses.align([1, 2], [5, 6], 0, 2) == (0, -1, -1)


def test_license_scan_of_odd_rows(spark, odd):
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty(spark)).count() == 0


# 3 mixing


def test_rates_meet_targets_and_stay_nonnegative(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(10, 500, 300)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    totals = (p * n[:, None]).sum(axis=0)
    for targets in (totals * [2.0, 1.0, 0.5], totals * [1.0, 0.1, 3.0], totals):
        path, reached = mixing.fit_rates(table, targets)
        rates = mixing._rates(n.astype(float), p, path)
        assert np.allclose(reached, targets, rtol=1e-4) and (rates >= 0).all()
        assert np.allclose((p * (n * rates)[:, None]).sum(axis=0), reached)


def test_mixing_takes_from_no_domain_and_counts_all_tokens(spark):
    texts = [("en", "the and of " + prose(i, 30)) for i in range(60)] + [("de", "der und das " + prose(i + 100, 30)) for i in range(12)] + [("de", None), ("en", "")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    rows = mixing.mix_to_targets(docs, labelled).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len((t or "").split()) for _, t in texts]
    german = np.mean([r.rate for r, (lang, t) in zip(rows, texts, strict=True) if lang == "de" and t])
    english = np.mean([r.rate for r, (lang, t) in zip(rows, texts, strict=True) if lang == "en" and t])
    assert german > 1.2 > english > 0.9 and rows[-1].rate == rows[-2].rate == 1.0
    assert all(abs(sum(r.posteriors) - 1) < 1e-6 for r in rows)
    zero = mixing.mix_to_targets(docs, labelled, targets={"en": 1000.0}, carry_text=False, steps=5).collect()
    assert all(r.rate >= 0 for r in zero) and mixing.mix_to_targets(empty(spark), labelled).count() == 0
    assert mixing.mix_to_targets(docs, labelled.limit(0)).count() == docs.count()


# 4 near duplicates


def test_golay_words_at_two_bits_share_an_index():
    patterns = [0] + [sum(1 << i for i in c) for k in (1, 2, 3) for c in itertools.combinations(range(23), k)]
    flips = [0] + [sum(1 << i for i in c) for k in (1, 2) for c in itertools.combinations(range(23), k)]
    words = np.array(patterns)
    mine, n = golay.near_codewords(words)
    assert set(n.tolist()) == {1, 6} and (np.bitwise_count(mine << 11) <= 23).all()
    for flip in flips:
        other, _ = golay.near_codewords(words ^ flip)
        assert (mine[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_keys_meet_at_four_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (ka, ia), (kb, ib) = neardup.keys_of(x), neardup.keys_of(y)
    assert {*zip(ia.tolist(), ka.tolist(), strict=True)} and all(set(ka[ia == i]) & set(kb[ib == i]) for i in range(len(x)))


def test_majority_bits():
    rng = np.random.default_rng(6)
    counts = np.array([0, 1, 2, 700, 0, 3])
    h = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    got, at = neardup.majority(h, counts), 0
    for n, fp in zip(counts.tolist(), got.tolist(), strict=True):
        part = [int(v) for v in h[at : at + n]]
        assert fp == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in part) > n)
        at += n


def test_components_are_those_of_all_pairs(spark, odd):
    long = prose(8, 400)
    near = [(100 + i, " ".join(w for j, w in enumerate(long.split()) if j != i * 7), "c", None) for i in range(20)]
    docs = odd.unionByName(spark.createDataFrame(near, odd.schema))
    rows = docs.select("doc_id", "text").collect()
    expected = brute.classes([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    for block in (neardup.BLOCK, 4):  # small blocks: groups are dealt out in pairs of blocks
        got = neardup.near_duplicates(docs, block=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.simhash & (2**64 - 1), r.component_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, brute.fingerprint(r.text), c or 0) for r, c in zip(rows, expected, strict=True))
    kept = [r.doc_id for r in neardup.drop_near_duplicates(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for r, c in zip(rows, expected, strict=True) if r.doc_id is not None}) and kept.count(None) == 1
    assert neardup.near_duplicates(empty(spark)).count() == 0 == neardup.drop_near_duplicates(empty(spark)).count()


def test_large_groups_of_close_fingerprints(spark):
    rng = np.random.default_rng(7)
    center = int(rng.integers(0, 2**62))
    prints = {center ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)} | {int(v) for v in rng.integers(0, 2**62, 50)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "simhash long")
    for block in (neardup.BLOCK, 16):
        edges = neardup.links(df, block=block).collect()
        root = {p: p for p in signed}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 8  # a star's member need not be within four bits of its centre
            root[find(e.a)] = find(e.b)
        expected = brute.classes(prints, prints)
        got = [find(p) for p in signed]
        assert len(set(got)) == len(set(expected)) and (block == 16 or len(edges) < 120 * len(prints))
        assert all((expected[i] == expected[0]) == (got[i] == got[0]) for i in range(len(prints)))


# 5 language


def test_language_is_told_on_held_out_rows(spark, sf_dir, tmp_path):
    rows = language.op5_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, odd):
    profiles = {"aa": language._ngrams(language._codes("lorem ipsum")).tolist()}
    got = {r.text: (r.lang_pred, r.score) for r in language.identify(odd, profiles).collect()}
    assert got[None] == got[""] == got["!!! ### $$$"] == ("und", 0.0) and got["x"][0] == "aa"
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.train_profiles(empty(spark).withColumn("lang", F.lit("x"))) == {}


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_both_ways_of_counting_ngrams_agree(text):
    codes = language._codes(text * 400)  # long enough for direct addressing
    if len(codes):
        grams, n = language._counted(codes)
        plain, m = np.unique(language._ngrams(codes), return_counts=True)
        order = np.argsort(grams)
        assert np.array_equal(grams[order], plain) and np.array_equal(n[order], m)


# 6 quality


def test_quality_is_told_on_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.op6_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9 and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_of_odd_rows_and_odd_labels(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (3, 0), (3, 0), (6, 7)], "doc_id long, quality int")
    weights = quality.train_quality(odd, labels)
    rows = quality.score_quality(odd, weights).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and "SCORE" not in rows[0].asDict()
    assert {r.score for r in quality.score_quality(odd, quality.train_quality(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score_quality(empty(spark), weights).count() == 0


def test_held_out_labels_teach_nothing(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, prose(i, 10)) for i in held], SCHEMA)
    assert quality.train_quality(docs, spark.createDataFrame([(i, 1) for i in held], "doc_id long, quality int")) is None


def test_features_are_those_of_each_text_alone():
    texts = ["one two  two!! three", "", "Ä two two", "!!"]
    data = "".join(texts).encode()
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    slots, rows, n = linear.features(np.frombuffer(data, np.uint8), offs)
    for i, t in enumerate(texts):
        alone, _, m = linear.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert sorted(slots[rows == i].tolist()) == sorted(alone.tolist()) and n[i] == m[0]


# 7 substrings


@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 60), st.integers(-1, 59)), min_size=1, max_size=7), st.sampled_from([b"ab", b"abcd", bytes(range(256))]), st.sampled_from([3, 8, 20]))
@settings(max_examples=150, deadline=None)
def test_run_index_gives_all_repeats(cuts, alphabet, length):
    rng = np.random.default_rng(len(alphabet))
    base = bytes(rng.choice(list(alphabet), 150).tolist())
    strings = []
    for a, n, change in cuts:
        s = bytearray(base[a : a + n])
        if 0 <= change < len(s):
            s[change] ^= 1
        strings.append(bytes(s))
    seen = {}
    for s in strings:
        for i in range(len(s) - length + 1):
            seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
    index = runindex.RunIndex(strings, length)
    got = {k: [i for a, b in zip(x[::2], x[1::2], strict=True) for i in range(a, b)] for k, x in index.repeated()}
    for k, s in enumerate(strings):
        assert got.get(k, []) == [i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]


def repeated_texts():
    passage, other = prose(20, 60), prose(21, 45)
    return [
        prose(22, 100) + passage + prose(23, 100), passage, "head " + passage + " " + other, other[5:] + prose(24, 30),
        "ab" * 700, prose(25, 20) + "xyz " * 120, None, "", "short", "ä" * 300 + passage[:230], prose(26, 300), prose(26, 300), passage[:199], "Orre " * 60,
    ]


@pytest.mark.parametrize(("owner_places", "levels"), [(substrings.OWNER_PLACES, substrings.LEVELS), (3, 2), (1, 1), (1, 0)])
def test_removed_bytes_are_those_of_all_windows(spark, owner_places, levels):
    texts = repeated_texts()
    docs = spark.createDataFrame(rows_of(texts) + [(None, texts[1])], SCHEMA)
    expected = brute.removed_windows([*texts, texts[1]])
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in substrings.dedup_substrings(docs, owner_places=owner_places, levels=levels, block_bytes=3000).collect()}
    for i, (n, gone, spans, sha) in enumerate(expected):
        r = got[i if i < len(texts) else -1]
        assert (r.n_bytes, sum(r.removed[1::2]) - sum(r.removed[::2]), len(r.removed) // 2, r.kept_sha256) == (n, gone, spans, sha), i


def test_substrings_of_odd_rows(spark, odd):
    assert substrings.dedup_substrings(odd).count() == odd.count()
    assert substrings.dedup_substrings(empty(spark)).count() == 0


# 8 decontamination


ITEMS = [(1, prose(30, 40)), (2, prose(31, 13)), (3, "Three short words"), (4, "word"), (5, ""), (6, None), (None, prose(32, 20)), (7, "Three short words"), (10, prose(30, 40)[30:])]


def contaminated_texts():
    a, b = ITEMS[0][1], ITEMS[1][1]
    return ODD + [a.upper(), b.replace(" ", " -- "), "x " + " ".join(a.split()[:12]), "x " + " ".join(a.split()[:13]) + " y", "three, SHORT words!", prose(33, 500) + " word", a + " " + b, " ".join(a.split()[5:30])]


@pytest.mark.parametrize("block_bytes", [16 << 20, 60])
def test_hits_are_those_of_all_windows(spark, block_bytes):
    texts = contaminated_texts()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute.contamination(texts, [x for x in ITEMS if None not in x])
    for r in decontaminate.decontaminate(docs, items, block_bytes=block_bytes).collect():
        n, hit, ids = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.items) == (n, hit, ids), r.doc_id
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(odd, items).count() == odd.count()
    assert decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty(spark), items).count() == 0


def test_decontamination_is_its_sql(spark, sf_dir):
    assert_same(decontaminate.op8_decontaminate(spark, sf_dir), connected(sf_dir), decontaminate.OP8_SQL)


# 9 rollup


def test_batches_are_applied_once_in_any_order(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, tokens long, bytes long, old_tokens long, old_bytes long"
    first = spark.createDataFrame([("insert", "s", "en", "t1", 10, 50, None, None), ("insert", "s", None, "t1", 5, 9, None, None), ("insert", "s", "en", "t1", None, None, None, None), ("odd", "s", "en", "t1", 99, 99, None, None)], schema)
    second = spark.createDataFrame([("delete", "s", None, "t1", 5, 9, None, None), ("revise", "s", "en", "t1", 12, 50, 10, 50)], schema)
    expected = {("s", "en", "t1", 2, 12, 50)}
    for order in ((first, second), (second, first)):
        store = rollup.Rollup(spark, str(tmp_path / f"r{id(order)}"))
        assert store.totals().count() == 0
        names = ["a" if x is first else "b" for x in order]
        assert all(store.apply(n, x) for n, x in zip(names, order, strict=True)) and not store.apply("a", first)
        assert {tuple(r) for r in store.totals().collect()} == expected
        store.compact()
        assert {tuple(r) for r in store.totals().collect()} == expected and not store.apply("b", second)
        assert store.apply("c", first) and store.totals().where("lang is null").first().docs == 1
    with pytest.raises(ValueError):
        store.apply("../x", first)


def test_a_batch_cut_off_before_its_commit_does_not_count(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([("insert", "s", "en", "t", 1, 1)], "op string, source string, lang string, tokenizer string, tokens long, bytes long")
    store.apply("a", rows)
    next((tmp_path / "batches" / "a").iterdir()).joinpath("_SUCCESS").unlink()
    assert store.totals().count() == 0 and store.apply("a", rows) and store.totals().first().docs == 1


def test_token_counts(spark, odd):
    counts = {r.text: r.n_tokens for r in rollup.count_words(odd).collect()}
    assert counts[None] == counts[""] == 0 and counts[ODD[6]] == 4000
    tiktoken = pytest.importorskip("tiktoken")
    assert tiktoken and rollup.count_bpe(odd).where("text = 'x'").first().n_tokens == 1


# 2 license scans: edits and neighbours


def test_licenses_with_edits_and_back_to_back(spark):
    texts = ["released under the mit license", "released under one mit license", "x a b c a b c a b c y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = licenses.scan_licenses(docs, templates={"mit": "Released under the MIT License.", "abc": "a b c"})
    got = {r.doc_id: [(m.license, m.coverage, m.first_word, m.last_word) for m in r.licenses] for r in found.collect()}
    assert got == {0: [("mit", 1.0, 0, 4)], 1: [("mit", 0.8, 0, 4)], 2: [("abc", 1.0, 1, 3), ("abc", 1.0, 4, 6), ("abc", 1.0, 7, 9)]}


# 10 sharding


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 50)), max_size=120))
@settings(max_examples=100, deadline=None)
def test_capacity_tree_is_a_sorted_list(steps):
    tree, plain = sharding.CapacityTree(), []
    for i, (put, value) in enumerate(steps):
        if put or not plain:
            tree.insert((value, i))
            plain.append((value, i))
        else:
            want = min((k for k in plain if k[0] >= value), default=None)
            assert tree.take(value) == want
            if want:
                plain.remove(want)


def test_packing_is_best_fit_decreasing():
    assert sharding.pack([(6, "a"), (5, "b"), (4, "c"), (3, "d"), (2, "e")], 10) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1}
    for seed in range(5):
        items = [(int(s), str(i)) for i, s in enumerate(np.random.default_rng(seed).integers(1, 1000, 400))]
        bins = sharding.pack_into(items, 16)
        sums = np.bincount([bins[n] for _, n in items], [s for s, _ in items], minlength=16)
        assert max(bins.values()) < 16 and sums.max() - sums.min() <= 0.01 * sums.mean() + 3
    assert sharding.pack_into([], 16) == {}


def _sums(items, shards):
    bins = sharding.pack_into(items, shards)
    assert set(bins) == {n for _, n in items} and max(bins.values()) < shards
    return np.bincount([bins[n] for _, n in items], [s for s, _ in items], minlength=shards)


def test_large_groups_leave_no_shard_empty():
    small = [(int(s), str(i)) for i, s in enumerate(np.random.default_rng(1).integers(1, 100, 4000))]
    total = sum(s for s, _ in small)
    for hot in ([total // 2], [total // 2, total // 4], [total // 2, total // 19]):
        sums = np.sort(_sums([*small, *[(s, f"hot{i}") for i, s in enumerate(hot)]], 16))
        rest = sums[: -len(hot)] if hot[-1] * 10 > total else sums[:-1]  # hot[0] of total + hot[0] is a third of all
        assert sums[-1] == hot[0] and rest.max() - rest.min() <= 0.01 * rest.mean() + 3
    sums = np.sort(_sums([*[(600, f"m{i}") for i in range(17)], *[(10, f"s{i}") for i in range(580)]], 16))
    assert sums[-1] == 1200 and sums[0] >= 0.9 * sums[:-1].mean()
    assert sorted(_sums([(7, "a"), (1, "b")], 1)) == [8] and sorted(_sums([(7, "a"), (1, "b")], 4)) == [0, 0, 1, 7]


def test_shards_hold_whole_groups_and_gapless_slots(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(200 + i, prose(40 + i % 50, 30), "c", None) for i in range(300)], odd.schema))
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    for text, group in itertools.groupby(sorted(rows, key=lambda r: r.text or ""), key=lambda r: r.text or ""):
        group = list(group)
        assert len({r.shard for r in group}) == 1 and all(r.size == len(text.encode()) + 1 for r in group)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(empty(spark)).count() == 0


# the pipeline


def test_pipeline_stages_do_what_plain_versions_do(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [f.__name__ for _, f in P.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    good = common.written(P.quality(spark, docs, sf_dir))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    known = [i for i in labels if labels[i] == 1]
    assert good.columns == docs.columns and sum(i in kept for i in known) >= 0.97 * len(known)
    one = common.written(P.near_dedup(spark, good, sf_dir))
    rows = good.collect()
    classes = brute.classes([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes))
    clean = common.written(P.decontamination(spark, one, sf_dir))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = one.collect()
    bad = {r.doc_id for r, (n, hit, _) in zip(rows, brute.contamination([r.text for r in rows], items), strict=True) if hit and 20 * hit >= n}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in rows} - bad)
    mixed = common.written(P.mixing(spark, clean, sf_dir))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()} and mixed.count() >= clean.count()
    out = P.sharding(spark, mixed, sf_dir)
    assert out.count() == mixed.count() and set(docs.columns) < set(out.columns)
    assert P.run(spark, sf_dir).count() == out.count()
