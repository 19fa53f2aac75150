"""Keys of parts of sets: no similar pair is lost, and sets alone in the world are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import setparts as P
from lorewright.operators import similar as M
from lorewright.operators.joins import among


def test_similar_sizes_are_in_one_class_or_the_next():
    for threshold in (0.5, 0.85, 0.9, 0.99):
        least, parts, spare = P.size_classes(threshold)
        for n in [*range(1, 3000), 10**6, 10**9]:
            of = [(least <= m).sum() - 1 for m in (n, int(threshold * n) + 1)]
            assert of[0] - of[1] in (0, 1)
            assert parts[of[0]] - spare[of[0]] > (1 - threshold) / (1 + threshold) * 2 * n


def _sets(seed):
    """Sets of 1 to 400 hashes and changed copies of them, about as similar as the bound."""
    random.seed(seed)
    out = []
    for size in [*range(1, 40), 60, 90, 150, 400] * 2:
        one = [random.getrandbits(64) - 2**63 for _ in range(size)]
        out.append(one)
        for _ in range(3):
            share = random.choice([0.0, 0.05, 0.08, 0.12])
            other = [random.getrandbits(64) - 2**63 if random.random() < share else x for x in one]
            out.append(other[: len(other) - random.randint(0, max(1, size // 12))])
    return [(f"s{i:04d}", sorted(set(s))) for i, s in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_similar_sets_share_a_key(spark, threshold):
    sets = _sets(3)
    rows = P.part_keys(spark.createDataFrame(sets, "id string, s array<bigint>"), threshold).collect()
    own, after = {r.id: set(r.own) for r in rows}, {r.id: set(r.next) for r in rows}
    bits = {r.id: [x & (2**64 - 1) for x in r.bits] for r in rows}
    held = {i: set(s) for i, s in sets}
    similar = 0
    for i in own:
        for j in own:
            if i < j and len(held[i] & held[j]) > threshold * len(held[i] | held[j]):
                similar += 1
                assert own[i] & (own[j] | after[j]) or after[i] & own[j]
                odd = sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[j], strict=True))
                assert odd <= len(held[i] ^ held[j]) < (1 - threshold) / (1 + threshold) * (len(held[i]) + len(held[j])) + 1e-6
    assert similar > 100 and [i for i, s in sets if not s] == sorted(held.keys() - own.keys())


def test_notes_with_frequent_word_pairs_are_not_compared(spark):
    """Word pairs that many notes have are no reason to compare them: 45,150 pairs of notes share some."""
    random.seed(4)
    words = [f"word{i}" for i in range(60)]
    rows = [(f"n{i:03d}", "t", " ".join(random.choices(words, k=200))) for i in range(300)]
    rows.append(("n300", "t", rows[7][2] + " one"))
    notes = spark.createDataFrame(rows, "id string, title string, content string")
    classes = M._Classes.of(notes, 0.85)
    assert 1 <= classes.pairs().count() < 300
    assert [(r.a, r.b) for r in M.near_content(notes).collect()] == [("n007", "n300")]


def test_a_bitmap_keeps_all_that_meet(spark):
    rows, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    for bits, most in ((1 << 25, 720), (64, 5000)):
        kept = {r.k for r in among(rows, "k", keys, bits).collect()}
        assert kept >= set(range(0, 5000, 7)) and len(kept) <= most
    assert among(rows, "k", keys.where(F.lit(False))).count() == 0
