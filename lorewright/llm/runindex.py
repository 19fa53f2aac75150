"""A run-length index of a text collection: run-compressed Burrows-Wheeler transform with sampled run ends.

The collection is a set of byte strings; no match goes over the end of one. The transform is cut into runs of one
preceding byte (a string's first position is a run of its own). Kept are, for each run, the text position of its first
suffix and of the suffix just before it (the end of the run before), and the length they share. By the toehold property
these samples say, for any position between two sampled ones, where a longest match is and how long: both move on with
the position, and the length falls by one. So matching statistics are streamed from a number of samples that
follows the runs, not the bytes: for repetitive collections, far fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SYMBOLS = 7  # nine bits each, in one 63-bit key; zero stands for the end of a string


def _keys(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first seven symbols of every suffix as one number."""
    n = len(text)
    code = np.zeros(n + _SYMBOLS, np.int64)
    code[:n] = text.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    left = ends - np.arange(n)
    for i in range(_SYMBOLS):
        key = (key << 9) | np.where(left > i, code[i : n + i], 0)
    return key


def suffix_array(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the rank of each (from 1; equal suffixes have the smallest rank of theirs), by prefix doubling.

    Equal suffixes of different strings stand in the order of their positions.
    """
    n = len(key)
    order = np.argsort(key)
    ordered = key[order]
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    first = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first + 1, np.diff(np.append(first, n)))
    length = _SYMBOLS
    todo = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in the order that are not settled
    equal = []
    while len(todo):
        suffix = order[todo]
        group = rank[suffix]
        ahead = suffix + length
        more = ahead < ends[suffix]
        # a suffix that has ended stands before the others of its group, beside equals that have ended too
        joint = group * (n + 1)
        joint[more] += rank[ahead[more]]
        moved = np.argsort(joint)
        suffix, joint, more = suffix[moved], joint[moved], more[moved]
        order[todo] = suffix
        new = np.empty(len(todo), bool)
        new[:1] = True
        np.not_equal(joint[1:], joint[:-1], out=new[1:])
        start = np.flatnonzero(new)
        rank[suffix] = np.repeat(todo[start] + 1, np.diff(np.append(start, len(todo))))
        alone = new & np.append(new[1:], True)
        equal.append(todo[~alone & ~more])
        todo = todo[~alone & more]
        length *= 2
    same = np.concatenate([*equal, np.zeros(0, np.int64)])  # places of equal suffixes
    if len(same):
        same.sort()
        suffix = order[same]
        order[same] = suffix[np.argsort(rank[suffix] * (n + 1) + suffix)]
    return order, rank


class RunIndex:
    """Index of ``strings``: ``samples`` (positions that begin a run, ascending), ``partner`` and ``shared`` of each."""

    def __init__(self, strings: list[bytes], least: int):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(sizes) - sizes
        self.least = least
        text = np.frombuffer(b"".join(strings), np.uint8)
        n = len(text)
        self.runs = 0
        self.samples = self.partner = self.shared = np.zeros(0, np.int64)
        self.size = n
        if n < 2:
            return
        ends = np.repeat(self.starts + sizes, sizes)
        key = _keys(text, ends)
        order, _ = suffix_array(key, ends)
        opens = np.zeros(n, bool)
        opens[self.starts[sizes > 0]] = True
        before = text[order - 1]  # the transform; at a string's first position it stands for the string's end
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | opens[order[1:]] | opens[order[:-1]]
        self.runs = int(head.sum())
        at = np.flatnonzero(head)[1:]  # the very first suffix has none before it
        sample, partner = order[at], order[at - 1]
        shared = _common(key, ends, sample, partner)
        by_position = np.argsort(sample)
        self.samples, self.partner, self.shared = sample[by_position], partner[by_position], shared[by_position]

    def long_matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, partner, count): ``count`` positions from each on match their partners over ``least`` bytes or more."""
        if not len(self.samples):
            return (np.zeros(0, np.int64),) * 3
        following = np.append(self.samples[1:], self.size)
        count = np.minimum(following - self.samples, self.shared - self.least + 1)
        use = count > 0
        return self.samples[use], self.partner[use], count[use]

    def repeated(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each string that has any: its number and the flat spans of its positions that begin a repeat of ``least`` bytes."""
        position, partner, count = self.long_matches()
        if not len(position):
            return
        change = np.zeros(self.size + 1, np.int64)
        for first in (position, partner):
            np.add.at(change, first, 1)
            np.add.at(change, first + count, -1)
        inside = np.cumsum(change) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside[: self.size], [False])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        # spans of neighbouring strings never touch, as the last positions of a string begin nothing that long
        owner = np.searchsorted(self.starts, begin, "right") - 1
        for cut in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            k = int(owner[cut[0]])
            yield k, np.stack([begin[cut], end[cut]], axis=1).ravel() - self.starts[k]


def _common(key: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, up to the nearer end."""
    most = np.minimum(ends[a] - a, ends[b] - b)
    out = most.copy()
    live = np.arange(len(a))
    done = 0
    while len(live):
        x, y = key[np.minimum(a[live] + done, len(key) - 1)], key[np.minimum(b[live] + done, len(key) - 1)]
        over = done >= most[live]
        differ = (x != y) & ~over
        if differ.any():
            apart = (x ^ y)[differ]
            bits = np.frexp(apart.astype(np.float64))[1]  # the place of the highest differing bit
            bits = np.where(apart >> np.minimum(bits - 1, 62) == 0, bits - 1, bits)  # the float may be rounded up
            same = (9 * _SYMBOLS - bits) // 9
            out[live[differ]] = np.minimum(done + same, most[live[differ]])
        live = live[~differ & ~over]
        done += _SYMBOLS
    return out
