"""The queries of the ten operators against plain versions that know nothing of them, and what odd input does to each."""

import json
import math
import random
import re
import subprocess
import sys
import warnings
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import common, decontaminate, language, licenses, linear, media, mixing, neardup, quality, rollup, sharding, substrings
from lorewright.llm.words import scan

from . import brute
from .test_llm import ODD, SCHEMA, prose, repeated_texts, rows_of


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables: documents as given, with a language and a source for each."""

    def make(texts, **tables):
        rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


# 1 media


def plain_fingerprint(samples):
    """Peak pairs, frame by frame, from the definition of the transform."""
    n = max(1, math.ceil((len(samples) - media.FRAME) / media.HOP) + 1)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    power = []
    for t in range(n):
        x = [(samples[t * media.HOP + i] - 128.0) * window[i] if t * media.HOP + i < len(samples) else 0.0 for i in range(media.FRAME)]
        row = []
        for k in range(media.FRAME // 2 + 1):
            re_, im = (sum(v * f(2 * math.pi * k * i / media.FRAME) for i, v in enumerate(x)) for f in (math.cos, math.sin))
            row.append(re_ * re_ + im * im)
        power.append(row)
    tops = [[max(range(lo, hi), key=lambda k: power[t][k]) for lo, hi in media.BANDS] for t in range(n)]
    found = []
    for t in range(n):
        for b in range(len(media.BANDS)):
            here = power[t][tops[t][b]]
            beside = [power[u][tops[u][b]] for u in (t - 1, t + 1) if 0 <= u < n]
            if here > 1e-6 and all(here >= x for x in beside):
                found.append((t, tops[t][b]))
    pairs = []
    for i, (t, f) in enumerate(found):
        for u, g in found[i + 1 : i + 1 + media.FAN]:
            if 0 < u - t <= media.SPAN:
                pairs.append(t << 19 | (f - 1) << 12 | (g - 1) << 5 | (u - t))
    return sorted(pairs)


def test_fingerprints_are_those_of_the_definition():
    for seed, text in enumerate((prose(70, 90), "A" * 300 + prose(71, 40), "short")):
        data = text.encode().ljust(64, b"\0")
        samples = np.frombuffer(data, np.uint8)
        assert media.fingerprint(samples).tolist() == plain_fingerprint(samples.tolist()), seed


def test_media_that_is_no_wav(spark):
    good = media.to_wav(b"\x80" * 64)
    stereo = bytearray(good)
    stereo[22] = 2
    rows = [(0, good), (1, b"no wav at all"), (2, good[:20]), (3, None), (4, b""), (5, bytes(stereo)), (6, b"RIFF" + b"\0" * 60)]
    got = {r.id: r for r in media.wav_features(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert bytes(got[0].payload) == b"\x80" * 64 and all(got[i].payload is None and got[i].fingerprint == [] for i in range(1, 7))


# 2 licenses


def edited(words, rng, filler):
    """As many words replaced or left out as the coverage allows, and up to a fifth put between."""
    words, gone = list(words), len(words) - math.ceil(licenses.COVERAGE * len(words) - 1e-9)
    for j in rng.sample(range(len(words)), gone):
        words[j] = rng.choice(filler) if rng.random() < 0.6 else ""
    words = [w for w in words if w]
    for _ in range(rng.randint(0, max(1, len(words) // 5))):
        words.insert(rng.randint(0, len(words)), rng.choice(filler))
    return words


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_recall_against_alignment_on_all_diagonals(name):
    rng = random.Random(name)
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    words = re.findall(r"[0-9a-z]+", licenses.TEMPLATES[name].lower())
    filler = [*prose(72, 30).split(), "the", "of", "and", "license", "this", "to", "software"]
    texts = [" ".join([*rng.choices(filler, k=15), *edited(words, rng, filler), *rng.choices(filler, k=15)]).encode() for _ in range(120)]
    tokens = scan(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    first = np.searchsorted(tokens.row, np.arange(len(texts) + 1), "left")
    got = index.matches(tokens.hash, tokens.row, first)
    there, found = 0, 0
    for r in range(len(texts)):
        said = tokens.hash[first[r] : first[r + 1]].tolist()
        if any(licenses.align(index.words[name], said, d, index.band)[0] >= index.least(name) for d in range(-len(words), len(said))):
            there += 1
            found += any(m[0] == name for m in got.get(r, ()))
    assert there > 25 and found >= 0.99 * there


def test_license_query(spark, folder):
    mit = licenses.TEMPLATES["mit-permission"]
    texts = [f"{prose(73, 40)} {mit} {prose(74, 40)} {mit}", prose(75, 60), None, "", "RELEASED under the Mit license", *ODD]
    got = {r.doc_id: r for r in licenses.op2_licenses(spark, folder(texts)).collect()}
    n = len(re.findall(r"[0-9A-Za-z]+", mit))
    assert got[0].spans == f"mit-permission:40:{39 + n},mit-permission:{80 + n}:{79 + 2 * n}" and got[0].n_matches == 2 and got[0].coverage == 1.0
    assert got[4].spans == "mit:0:4" and len(got) == len(texts)
    assert all(got[i].n_matches == 0 and got[i].spans == "" and got[i].coverage is None for i in range(1, len(texts)) if i != 4)


# 3 mixing


def plain_rates(n, p, targets, scale, steps=20_000):
    """Accelerated projected gradient on all rates at once."""
    a = (p * n[:, None] / scale).T
    want = targets / scale
    step = 1.0 / np.linalg.norm(a @ a.T, 2)
    w = y = np.ones(len(n))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - want)))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


@pytest.mark.parametrize("targets", [[0.0, 1.0, 1.0], [0.0, 0.0, 2.0], [5.0, 0.2, 1.0]])
def test_fitted_totals_are_those_of_a_plain_solver(spark, targets):
    rng = np.random.default_rng(4)
    p = np.round(rng.dirichlet([0.15, 0.15, 0.15], 250), 9)
    n = rng.integers(10, 400, 250).astype(float)
    totals = (p * n[:, None]).sum(axis=0)
    wanted = totals * targets
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    path, reached = mixing.fit_rates(table, wanted)
    scale = mixing.scales(wanted, n.sum())
    rates = mixing._rates(n, p, path)
    assert (rates >= 0).all() and np.allclose((p * (n * rates)[:, None]).sum(axis=0), reached)
    best = (p * (n * plain_rates(n, p, wanted, scale))[:, None]).sum(axis=0)
    mine, its = (np.linalg.norm((x - wanted) / scale) for x in (reached, best))
    assert mine <= its + 0.03


def two_languages(n=90):
    return [(i, ("the and of " if i % 3 else "der und das ") + prose(i, 30), "en" if i % 3 else "de") for i in range(n)]


def test_a_zero_target_is_near_zero_and_others_hold(spark):
    docs = spark.createDataFrame(two_languages(), "doc_id long, text string, lang string")
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        mix = mixing.fit_mix(docs, labelled, targets={"en": 2000.0, "de": 0.0})
    rows = mix.rows.collect()
    told = {d: float(m) for d, m in zip(mix.domains, mix.miss, strict=True)}
    n, p = np.array([float(r.n_tokens) for r in rows]), np.array([r.posteriors for r in rows])
    scale = mixing.scales(mix.targets, n.sum())
    best = (p * (n * plain_rates(n, p, mix.targets, scale))[:, None]).sum(axis=0)  # the classifier leaves some German in English texts
    assert told["en"] < 0.02 and told["de"] <= abs(best[mix.domains.index("de")]) / scale[mix.domains.index("de")] + 0.03
    sums = np.sum([np.array(r.posteriors) * r.n_tokens * r.rate for r in rows], axis=0)
    assert np.allclose(sums, mix.reached, rtol=1e-6)


def test_targets_that_cannot_be_met_are_told(spark):
    docs = spark.createDataFrame(two_languages(), "doc_id long, text string, lang string")
    labelled = docs.select("doc_id", F.lit("en").alias("domain")).unionAll(docs.select("doc_id", F.lit("de")))  # both labels for all
    with pytest.warns(UserWarning, match="no nonnegative rates"):
        mix = mixing.fit_mix(docs, labelled, targets={"en": 9000.0, "de": 1000.0}, carry_text=False)
    assert (mix.miss > mixing.MISS).any()
    for bad in ({"xx": 1.0}, {"en": -1.0}):
        with pytest.raises(ValueError, match="targets"):
            mixing.fit_mix(docs, labelled, targets=bad)
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), "id").alias("domain"))
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_mix(docs, many)


def test_mixing_query_meets_its_targets(spark, folder):
    texts = [t for _, t, _ in two_languages()] + [None, "", "   "]
    got = mixing.op3_mixing(spark, folder(texts)).collect()
    assert len(got) == len(texts) and all(r.rate >= 0 for r in got)
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [len((t or "").split()) for t in texts]
    now = np.sum([np.array(r.posteriors) * r.n_tokens for r in got], axis=0)
    then = np.sum([np.array(r.posteriors) * r.n_tokens * r.rate for r in got], axis=0)
    assert np.allclose(then, mixing.flattened(now), rtol=1e-3)
    assert all(abs(r.copies - r.rate) < 1 for r in got)


def test_mixing_of_odd_rows(spark):
    rows = [(None, "the and of", "x", 1), (1, "the and of", "x", 1), (1, "the and of", "x", 1), (2, None, "x", 2), (3, "", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RATE string, copies long")
    labelled = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None), (2, "a")], "doc_id long, domain string")
    with warnings.catch_warnings(record=True):
        got = mixing.mix_to_targets(docs, labelled).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "n_tokens", "posteriors", "rate", "copies"}
    assert len({r.rate for r in got if r.text == "the and of"}) == 1 and {r.rate for r in got if not r.text} == {1.0}


# 4 near duplicates


def test_near_duplicate_query(spark, folder):
    long = prose(76, 300).split()
    texts = [*ODD, *[" ".join(w for j, w in enumerate(long) if j != i * 11) for i in range(12)], *[prose(77, 50)] * 4]
    got = {r.doc_id: r for r in neardup.op4_near_duplicates(spark, folder(texts)).collect()}
    prints = [brute.fingerprint(t) for t in texts]
    classes = brute.classes(list(range(len(texts))), prints)
    assert all(got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == classes[i] for i in range(len(texts)))


# 5 language


def plain_ngrams(text):
    """1- to 3-grams of letters and spaces between words."""
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower()))
    line = " " + " ".join(words) + " " if words else ""
    grams = Counter(c for c in line if c != " ")
    grams.update(line[i : i + 2] for i in range(len(line) - 1))
    grams.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return grams


def packed(gram):
    codes = [language._EDGE if c == " " else ord(c) for c in gram]
    return codes[0] | sum((c + 1) << 21 * (i + 1) for i, c in enumerate(codes[1:]))


def order(grams):
    return sorted(grams, key=lambda g: (-grams[g], packed(g)))[: language.RANKS]


def test_language_query_is_the_plain_out_of_place_distance(spark, tmp_path):
    rows = [(i, t, "en" if i % 3 else "de") for i, t, _ in two_languages(60)] + [(100 + i, t, "en") for i, t in enumerate(ODD)] + [(200, "ähnlich größer", None), (201, None, "fr"), (202, "123", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    profiles = {}
    for i, t, lang in rows:
        if lang and t is not None and not held_out(i):
            profiles.setdefault(lang, Counter()).update(plain_ngrams(t))
    profiles = {lang: order(g) for lang, g in profiles.items() if g}
    for r in language.op5_language(spark, str(tmp_path)).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        top = order(plain_ngrams(text or ""))
        assert r.held_out == held_out(r.doc_id)
        if not top:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        apart = {lang: sum(abs(p.index(g) - k) if g in p else language.RANKS for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=lambda lang: apart[lang])
        assert r.lang_pred == best and math.isclose(r.score, 1 - apart[best] / (language.RANKS * len(top)), abs_tol=1e-12), r.doc_id


def test_long_texts_are_counted_in_blocks():
    text = (prose(78, 400) + " Ünï 12 ß\n") * 3
    whole = dict(zip(*map(np.ndarray.tolist, language.counted(text)), strict=True))
    assert whole == {packed(g): n for g, n in plain_ngrams(text).items()}
    for size in (1, 2, 7, 1000):
        assert dict(zip(*map(np.ndarray.tolist, language.counted(text, size)), strict=True)) == whole


# 6 quality


def plain_ftrl(examples, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3, epochs=3):
    """Follow the regularised leader, one coordinate after the other; examples are (slot to value, label)."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            x, label = examples[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_query_is_a_plain_classifier(spark, tmp_path):
    good, bad = prose(79, 30).split()[:9], prose(80, 30).split()[-9:]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=25)) + ("!!" if i % 5 == 0 else ".")) for i in range(80)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2) for i, _ in rows[:60]] + [(70, None), (71, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    def features(text):
        data = (text or "").encode()
        slots, _, n = linear.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return {s: k * linear.SCALE / max(1, n[0]) for s, k in Counter(slots.tolist()).items()} | {1 << linear.BITS: 1.0}

    text = dict(rows)
    rank = {r.doc_id: r.h for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    taught = sorted((rank[i], str(q), i) for i, q in labels if q in (0, 1) and not held_out(i))
    weights = plain_ftrl([(features(text[i]), float(q == "1")) for _, q, i in taught], epochs=4)
    got = quality.op6_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        margin = sum(weights.get(s, 0.0) * v for s, v in features(text[r.doc_id]).items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), abs_tol=1e-4) and r.predicted == int(r.score >= 0.5) and r.held_out == held_out(r.doc_id)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 80)


# 7 substrings


def test_substring_query(spark, folder):
    texts = repeated_texts()
    got = {r.doc_id: tuple(r)[1:] for r in substrings.op7_substrings(spark, folder(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute.removed_windows(texts)


def test_hot_owners_copies_and_passages(spark):
    passage = prose(81, 60)
    texts = [f"{prose(1000 + i, 12)} {passage} {prose(3000 + i, 12)}" for i in range(60)] + [prose(82, 200)] * 90 + [passage[: 150 + i] + prose(4000 + i, 30) for i in range(30)]
    expected = brute.removed_windows(texts)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for limits in ({}, {"owner_places": 20}, {"owner_places": 5, "levels": 1}):
        got = {r.doc_id: (r.n_bytes, sum(r.removed[1::2]) - sum(r.removed[::2]), len(r.removed) // 2, r.kept_sha256) for r in substrings.dedup_substrings(docs, **limits).collect()}
        assert [got[i] for i in range(len(texts))] == expected


# 8 decontamination


def test_contamination_query(spark, folder):
    a = prose(83, 40)
    texts = [*ODD, a.upper(), " ".join(a.split()[3:20]) + " " + prose(84, 100), prose(85, 400) + " " + " ".join(a.split()[:13])]
    items = [("q1", a), ("q2", "three short words"), ("q10", a), ("q3", None), ("q4", "")]
    got = {r.doc_id: r for r in decontaminate.op8_decontaminate(spark, folder(texts, benchmark=spark.createDataFrame(items, "item_id string, text string"))).collect()}
    for i, (n, hit, ids) in enumerate(brute.contamination(texts, [x for x in items if x[1]])):
        import hashlib

        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(ids))
        assert got[i].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() and got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_a_full_block_of_patterns_is_small():
    """Memory of a worker that holds a full block and searches some megabytes with it."""
    code = """
import json, resource, sys
import numpy as np, pyarrow as pa
from lorewright.llm import decontaminate as D
rng = np.random.default_rng(0)
vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(20_000)]
prose = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n))
items, size = [], 0
while size < D.BLOCK_BYTES:
    items.append((str(len(items)), prose(150)))
    size += len(items[-1][1])
texts = pa.array([prose(400) for _ in range(1500)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = D._Found(texts)
found.look(D.Patterns(items))
found.columns()
print(json.dumps((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024))
"""
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300, check=True)
    assert json.loads(out.stdout) < 350


# 9 token counts


def test_token_count_query(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(rollup.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("plain", pat_str=rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, prose(86, 40), prose(86, 40), prose(86, 40), "x", "it's 12 o'clock\n\n  now"]
    expected = Counter()
    for i, t in enumerate(texts):
        key, said = (f"s{i % 2}", ("en", "de", None)[i % 3]), t or ""
        sizes = {"words-1": len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", said.encode())), "bpe50k-1": len(encoding.encode_ordinary(said))}
        for tokenizer, n in sizes.items():
            if tokenizer == "words-1" or said not in [x or "" for x in texts[:i]]:
                for name, v in (("docs", 1), ("tokens", n), ("bytes", len(said.encode()))):
                    expected[*key, tokenizer, name] += v
    got = Counter()
    for r in rollup.op9_token_counts(spark, folder(texts)).collect():
        for name in ("docs", "tokens", "bytes"):
            got[r.source, r.lang, r.tokenizer, name] += r[name]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}


def test_long_texts_are_encoded_in_parts():
    text = prose(87, 3000) + "'s  12 \n" + "A" * 900 + " it's over"
    for size in (1, 10, 500):
        parts = list(rollup._pieces(text, size))
        assert "".join(parts) == text and len(parts) > 3
        pattern = __import__("regex").compile(rollup.PATTERN)
        assert [x for p in parts for x in pattern.findall(p)] == pattern.findall(text)


def test_two_writers_of_one_batch_count_once(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([("insert", "s", "en", "t", 1, 1)], "op string, source string, lang string, tokenizer string, tokens long, bytes long")
    store.apply("a", rows)
    store.committed = lambda batch_id: False  # the other writer looked before the first one was done
    assert store.apply("a", rows)
    assert store.totals().first().docs == 1
    del store.committed
    store.compact()
    store.compact()
    assert store.totals().first().docs == 1 and not store.apply("a", rows) and store.apply("b", rows) and store.totals().first().docs == 2


# 10 sharding


def test_sharding_query(spark, folder):
    texts = [*ODD, *[prose(88, 200)] * 9, *[prose(100 + i, 20 + i % 30) for i in range(400)]]
    got = sorted(sharding.op10_sharding(spark, folder(texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.size, r.text_crc32, r.law, r.grown_shard) for r in got] == [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for t in texts]
    by_text = {}
    for r, t in zip(got, texts, strict=True):
        assert by_text.setdefault(t or "", r.shard) == r.shard
    sums = np.bincount([r.shard for r in got], [r.size for r in got], minlength=16)
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    plain = sharding.pack_into([(n, t) for t, n in groups.items()], 16)
    best = np.bincount([plain[t] for t in groups], [groups[t] for t in groups], minlength=16)
    assert max(sums) - min(s for s in sums if s) <= 1.1 * (max(best) - min(best)) + 200
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("cell", [sharding.CELL, 60])
def test_fixed_capacity_takes_few_shards(spark, cell):
    rng = np.random.default_rng(9)
    sizes = [*rng.integers(1, 400, 500).tolist(), 1500, 2600, 700, 700]
    groups = spark.createDataFrame([(f"g{i}", int(n)) for i, n in enumerate(sizes)], "__group string, bytes long")
    got = {r["__group"]: r.shard for r in sharding.pack_groups(groups, 1000, cell=cell).collect()}
    assert len(got) == len(sizes) and set(got.values()) == set(range(max(got.values()) + 1))
    sums = Counter()
    for i, n in enumerate(sizes):
        sums[got[f"g{i}"]] += n
    over = [s for s, n in sums.items() if n > 1000]
    assert len(over) == 2 and all(sum(v == s for v in got.values()) == 1 for s in over)  # groups above the capacity, alone
    least = 2 + math.ceil((sum(sizes) - 4100) / 1000)
    assert len(sums) <= least + (1 if cell > 1000 else 3)


def test_shards_of_a_capacity(spark):
    docs = spark.createDataFrame([*rows_of(ODD), (None, "x"), *[(900 + i, prose(200 + i % 40, 25)) for i in range(120)]], SCHEMA)
    rows = sharding.shard(docs, capacity=3000).collect()
    assert len(rows) == docs.count() and len({(r.text or "", r.shard) for r in rows}) == len({r.text or "" for r in rows})
    for s in {r.shard for r in rows}:
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and (sum(r.size for r in mine) <= 3000 or len({r.text for r in mine}) == 1)
    assert sharding.shard(docs.limit(0), capacity=10).count() == 0


# long texts


def test_texts_of_megabytes(spark, folder, sf_dir):
    long = prose(89, 350_000)
    assert len(long) > 2_000_000
    texts = [long, "a" * 2_000_000, "ä " * 300_000, long[:1_000_000], None]
    path = folder(texts, benchmark=spark.createDataFrame([("q", prose(90, 30))], "item_id string, text string"), labels=spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, quality int"))
    from lorewright.llm.queries import QUERIES

    for name, query in QUERIES.items():
        with warnings.catch_warnings(record=True):
            got = query(spark, path).collect()
        assert len(got) == len(texts) or name == "op9_token_counts", name
    assert common.written(spark.range(3)).count() == 3
