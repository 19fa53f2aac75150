"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
#: x**11 + x**9 + x**7 + x**6 + x**5 + x + 1, which divides x**23 + 1 over GF(2)
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of every 23-bit word; error of each syndrome; whether it has three bits; the offsets to codewords at distance four."""
    unit = [_remainder(1 << i) for i in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for table, first in ((low, 0), (high, 12)):
        for i in range(len(table).bit_length() - 1):
            table[1 << i : 2 << i] = table[: 1 << i] ^ unit[first + i]
    error = np.zeros(1 << 11, np.int64)
    weight = np.zeros(1 << 11, np.int64)
    for k in range(4):
        for bits in combinations(range(LENGTH), k):
            syndrome = 0
            for i in bits:
                syndrome ^= unit[i]
            error[syndrome], weight[syndrome] = sum(1 << i for i in bits), k
    # the codewords of weight 7; with a 3-bit error inside one of them, it is at distance 4
    message = np.arange(1 << MESSAGE, dtype=np.int64) << 11
    code = message ^ low[message & 0xFFF] ^ high[message >> 12]
    seven = code[np.bitwise_count(code) == 7]
    around = np.zeros((1 << 11, 5), np.int64)
    for s in np.flatnonzero(weight == 3):
        around[s] = seven[(seven & error[s]) == error[s]]
    return np.stack([low, np.resize(high, 1 << 12)]), error, weight == 3, around


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of codewords near each 23-bit word: an (n, 6) array and how many of each row count (1 or 6).

    A word within two bits of its codeword gets that one; a word at three bits also gets the five codewords at four
    bits. Any two words that differ in at most two bits then have an index in common.
    """
    (low, high), error, three, around = _tables()
    s = low[words & 0xFFF] ^ high[words >> 12]
    nearest = words ^ error[s]
    found = np.repeat(nearest[:, None], 6, axis=1)
    found[:, 1:] ^= np.where(three[s][:, None], around[s], 0)
    return found >> 11, np.where(three[s], 6, 1)
