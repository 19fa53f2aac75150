"""License scans of long templates: recall under edits, coverage against a full alignment, cost on unrelated text."""

import random
import time

import numpy as np
import pytest

from lorewright.llm import licenses
from lorewright.llm.words import scan

WORDS = [f"w{i}" for i in range(800)]
COMMON = [1 / (i + 1) for i in range(800)]  # as in prose, few words are most of a text


def prose(rng, n):
    return rng.choices(WORDS, COMMON, k=n)


def edited(words, kind, share, rng):
    out, n = list(words), int(share * len(words))
    if kind == "replaced":
        for i in rng.sample(range(len(out)), n):
            out[i] = f"other{rng.randint(0, 9)}"
    if kind in ("left out", "both"):
        for i in sorted(rng.sample(range(len(out)), n), reverse=True):
            del out[i]
    if kind in ("put between", "both"):
        for _ in range(n):
            out.insert(rng.randint(0, len(out)), rng.choice(WORDS))
    return out


def scanned(index, texts):
    data = [" ".join(t).encode() for t in texts]
    tokens = scan(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    first = np.searchsorted(tokens.row, np.arange(len(data) + 1), "left")
    return index.matches(tokens.hash, tokens.row, first), tokens, first


def full_alignment(template, words):
    """Matches of the best local alignment over all diagonals."""
    row, best = [(0, 0)] * (len(words) + 1), (0, 0)
    for t in template:
        here = [(0, 0)]
        for j, w in enumerate(words):
            diagonal = (row[j][0] + 2, row[j][1] + 1) if w == t else (row[j][0] - 1, row[j][1])
            here.append(max((0, 0), diagonal, (row[j + 1][0] - 1, row[j + 1][1]), (here[j][0] - 1, here[j][1])))
        row, best = here, max(best, *here)
    return best[1]


@pytest.mark.parametrize("size", [60, 220, 600, 1500])
@pytest.mark.parametrize(("kind", "share"), [("left out", 0.18), ("replaced", 0.18), ("put between", 0.2), ("both", 0.15)])
def test_edited_copies_of_long_templates_are_found(size, kind, share):
    rng = random.Random(f"{size} {kind}")
    template = prose(rng, size)
    index = licenses.LicenseIndex({"t": " ".join(template)})
    copies = [edited(template, kind, share, rng) for _ in range(12)]
    texts = [[*prose(rng, 200), *c, *prose(rng, 200)] for c in copies]
    got, _, _ = scanned(index, texts)
    true = 1 - (0 if kind == "put between" else int(share * size) / size)
    for r, copy in enumerate(copies):
        assert len(got[r]) == 1
        _, coverage, first, last = got[r][0]
        assert abs(coverage - true) < 0.01 + 2 / size
        assert abs(first - 200) < 12 + size // 20 and abs(last - 199 - len(copy)) < 12 + size // 20


def test_coverage_is_that_of_a_full_alignment():
    rng = random.Random(8)
    template = prose(rng, 160)
    index = licenses.LicenseIndex({"t": " ".join(template)})
    texts = [[*prose(rng, 60), *edited(template, kind, share, rng), *prose(rng, 60)] for kind in ("left out", "replaced", "put between", "both") for share in (0.05, 0.12, 0.17)]
    got, tokens, first = scanned(index, texts)
    for r in range(len(texts)):
        best = full_alignment(index.words["t"], tokens.hash[first[r] : first[r + 1]].tolist())
        assert abs(got[r][0][1] - best / 160) < 0.01


def test_full_texts_stand_twice_beside_each_other_and_with_others():
    index = licenses.LicenseIndex(licenses.TEMPLATES | licenses.FULL_TEXTS)
    rng = random.Random(4)
    for name, text in licenses.FULL_TEXTS.items():
        got, _, _ = scanned(index, [[*prose(rng, 30), text, text, *prose(rng, 30)], [text[: len(text) // 2]], prose(rng, 500)])
        n = len(index.words[name])
        assert [m for m in sorted(got[0], key=lambda m: m[2]) if m[0] == name] == [(name, 1.0, 30, 29 + n), (name, 1.0, 30 + n, 29 + 2 * n)]
        assert all(m[0] != name for m in got.get(1, [])) and not got.get(2)


def test_unrelated_text_costs_little():
    rng = random.Random(9)
    index = licenses.LicenseIndex({"t": " ".join(prose(rng, 5600))})
    scanned(index, [prose(rng, 2000)])
    began = time.perf_counter()
    got, _, _ = scanned(index, [prose(rng, 2000)])
    assert time.perf_counter() - began < 0.05 and not got.get(0)


def test_a_template_of_one_word_again_and_again():
    index = licenses.LicenseIndex({"t": "word " * 50})
    got, _, _ = scanned(index, [["word"] * 50, ["other"] * 50, ["word"] * 120])
    assert [m[1] for m in got[0]] == [1.0] and not got.get(1)
