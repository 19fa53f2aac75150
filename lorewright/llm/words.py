"""Vectorised word scanning over the UTF-8 bytes of many texts at once (numpy, no loop per word)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 word (ASCII letters and digits, every byte of a non-ASCII character), 2 punctuation
_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_STEP, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Tokens:
    """Tokens of consecutive texts: byte span, hash, kind and the row each belongs to."""

    lower: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    kind: np.ndarray
    row: np.ndarray


def scan(data: np.ndarray, offs: np.ndarray, punctuation: bool = False) -> Tokens:
    """Cut texts into runs of word bytes (A-Z lower-cased) and, if asked for, runs of punctuation."""
    n = len(data)
    lower = _LOWER[data]
    kind = _KIND[data]
    if not punctuation:
        kind = np.where(kind == 1, kind, 0).astype(np.uint8)
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n]) if n else None
    new[offs] = True
    cuts = np.flatnonzero(new)
    start, end = cuts[:-1], cuts[1:]
    kinds = kind[start] if n else np.zeros(0, np.uint8)
    real = kinds > 0
    start, end, kinds = start[real], end[real], kinds[real]
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    hashed = mix(value ^ (end - start).astype(np.uint64))
    # a text without bytes shares its offset with the next one; "right" gives the row that owns the byte
    row = np.searchsorted(offs, start, "right") - 1
    return Tokens(lower, start, end, hashed, kinds, row)
