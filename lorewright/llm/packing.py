"""Operator 12, best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Documents are cut to pieces of at most ``capacity`` tokens, and only the histogram of piece lengths (``capacity`` rows at
most, at any number of documents) comes to the driver. A configuration says how many pieces of each length share a
sequence; the program asks for the fewest sequences whose configurations cover the histogram. Multiplicative weights solve
it: each round prices the lengths (a length that is covered better gets cheaper), a knapsack dynamic program over the
capacity finds the configurations of the highest price, one for each length that has one, and these cover a little more.
Any prices bound the number of sequences from below. The fractional solution is rounded: whole parts first, then single
sequences by falling fraction as long as their pieces are there; what is left is filled sequence by sequence, the longest
piece first and with it the pieces that leave the least room (a subset-sum program), each such filling as often as it fits.
Where that is above the lower bound, what the whole parts leave (and, where a fit to few pieces is poor, all) is also packed
without single sequences and by best-fit-decreasing, and the way with the fewest sequences counts.
Pieces then find their place by length and number within the length.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lists, map_text, read_table, text_bytes, written
from .rollup import PATTERN
from .sharding import _slots

CAPACITY = 2048
#: Rounds of the multiplicative weights, how strongly they answer, and which share of the best price a configuration has.
ROUNDS, RATE, NEAR = 48, 4.0, 0.002
#: The ranks of the public vocabulary ``byte_bpe_50k.json`` (the same ids, encoded four times as fast); the file must be on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose ids a worker keeps.
KEPT = 1 << 19
#: Parts that the pieces of one length are numbered in; above so many pieces the larger number.
PARTS, MORE_PARTS, MANY = 64, 512, 64_000_000


# tokens


#: ASCII letters, digits and the other visible characters; 0 is everything else, non-ASCII characters too.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _encoder(vocabulary: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """A function from words to the ids of all and the number of ids of each."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(x) for x in ranks]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        said = [w.decode() for w in words]
        # of white space and then anything up to a visible character: one after the other they are encoded as each alone
        apart = np.array([not (_SPACE[w[0]] and not s[-1].isspace()) for w, s in zip(words, said, strict=True)], bool)
        one_by_one = [encoding.encode_ordinary(s) for s, x in zip(said, apart.tolist(), strict=True) if x]
        chain = np.asarray(encoding.encode_ordinary("".join(s for s, x in zip(said, apart.tolist(), strict=True) if not x)), np.int64)
        ends = np.cumsum([len(w) for w, x in zip(words, apart.tolist(), strict=True) if not x])
        size = np.empty(len(words), np.int64)
        size[apart] = [len(x) for x in one_by_one]
        size[~apart] = np.diff(np.searchsorted(np.cumsum(width[chain]), ends, "right"), prepend=0)
        ids = np.empty(int(size.sum()), np.uint32)
        alone = np.repeat(apart, size)
        ids[alone] = list(itertools.chain.from_iterable(one_by_one))
        ids[~alone] = chain
        return ids, size

    return encode


class _Words:
    """Encodes words, and keeps the ids of the first ``KEPT`` of them for as long as the worker lives."""

    def __init__(self, vocabulary: str):
        self.encode, self.known = _encoder(vocabulary), {}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids at hand, and where those of each word start and how many they are."""
        known, old = self.known, len(self.known)
        at = np.array([known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = old + np.arange(len(new))
        more, sizes = self.encode([words[i] for i in new.tolist()])
        flat, size = np.concatenate([self.flat, more]), np.concatenate([self.size, sizes])
        first = np.cumsum(size) - size
        kept = new[: KEPT - old]
        known.update(zip((words[i] for i in kept.tolist()), range(old, old + len(kept)), strict=True))
        self.size = size[: len(known)]
        self.flat = flat[: int(self.size.sum())]
        return flat, first[at], size[at]


@functools.lru_cache(maxsize=1)
def _words(vocabulary: str) -> _Words:
    return _Words(vocabulary)


def tokens_of(data: np.ndarray, offs: np.ndarray, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts, and the n+1 row offsets among them.

    A match of the vocabulary's word pattern never goes from a visible character to white space, nor between ASCII letters,
    digits and other visible characters (but for an apostrophe and the letters after it), so texts are cut there; equal
    cuts have equal tokens, which are looked up once.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    kind = _CLASS[data]
    cut = np.ones(n, bool)
    before, here = kind[:-1], kind[1:]
    cut[1:] = (before > 0) & (_SPACE[data[1:]] | (here > 0) & (here != before) & ~((data[:-1] == 39) & (here == 1)))
    cut[offs[offs < n]] = True
    at = np.flatnonzero(cut)
    ends = np.append(at, n).astype(np.int64)
    tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = tiles.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first, size = encode(tiles.dictionary.to_pylist())
    many = size[which]
    total = np.concatenate(([0], np.cumsum(many)))
    return flat[np.repeat(first[which] - total[:-1], many) + np.arange(total[-1])], total[np.searchsorted(at, offs)]


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])


def cut_pieces(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``pieces`` (start, length and crc32 of the ids): a text's tokens and an id 0 at its end.

    Only longer ones are cut, into pieces of ``capacity`` tokens of which the first may be shorter. A null text counts as empty.
    """

    def make():
        encode = _words(vocabulary)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, rows = tokens_of(*text_bytes(texts), encode)
            start, length, crc, counts = [], [], [], []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                body = ids[a:b].tobytes() + b"\0\0\0\0"
                n, at = b - a + 1, 0
                step = n % capacity or min(n, capacity)
                counts.append(-(-n // capacity))
                while at < n:
                    start.append(at)
                    length.append(step)
                    crc.append(zlib.crc32(body[4 * at : 4 * (at + step)]))
                    at, step = at + step, capacity
            made = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, crc)], names=PIECE.fieldNames())
            return [lists(made, np.array(counts, np.int64), made.type)]

        return work

    return map_text(docs, text, make, T.StructType([T.StructField("pieces", T.ArrayType(PIECE))]), carry_text)


# the program


@dataclass
class Packing:
    """``fillings``: (pieces of each length, number of sequences filled so); ``bound``: no packing has fewer sequences."""

    bound: int = 0
    fillings: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def _priced(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price of each room, and the length (its number) that the best filling of the room takes first, or -1."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c], choice[c] = best[c - 1], -2  # one token of room stays free
        if n:
            value = best[c - lengths[:n]] + price[:n]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], choice[c] = value[j], j
    return best, choice


def _filling(first: int, room: int, lengths: list[int], choice: list[int], there: list[int]) -> tuple[tuple[int, int], ...]:
    """Numbers of the lengths in a filling that has ``first``, no more of any than there are."""
    many = Counter([first])
    while room > 0:
        j = choice[room]
        if j == -1:
            break
        if j == -2:
            room -= 1
            continue
        if many[j] < there[j]:
            many[j] += 1
        room -= lengths[j]
    return tuple(sorted(many.items()))


def _fractional(lengths: np.ndarray, there: np.ndarray, capacity: int, rounds: int) -> tuple[dict, float]:
    """Configurations and how many sequences of each cover the histogram, fractions included; and a lower bound."""
    amount: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    bound, all_lengths, counts = 0.0, lengths.tolist(), there.tolist()
    for _ in range(rounds):
        behind = covered - covered.mean()
        price = lengths / capacity * np.exp(np.clip(-RATE * behind / max(1.0, covered.mean()), -2, 2))
        best, choice = _priced(lengths, price, capacity)
        bound = max(bound, float((there * price).sum() / best[capacity]))
        alike = np.flatnonzero(price + best[capacity - lengths] >= (1 - NEAR) * best[capacity])
        steps = choice.tolist()
        inc, used = np.zeros(len(lengths)), []
        for i in alike.tolist():
            c = _filling(i, capacity - all_lengths[i], all_lengths, steps, counts)
            share = min(counts[j] / a for j, a in c)
            used.append((c, share))
            for j, a in c:
                inc[j] += share * a / counts[j]
        step = 1 / max(1.0, inc.max())
        for c, share in used:
            amount[c] = amount.get(c, 0.0) + share * step
        covered += inc * step
    whole = float((covered * there * lengths).sum() / (there * lengths).sum())
    return {c: x / max(whole, 1e-9) for c, x in amount.items()}, bound


def _subset(lengths: list[int], there: list[int], room: int) -> Counter:
    """Pieces, no more of any length than there are, that fill the room as far as can be."""
    reach, trail = 1, []
    mask = (1 << (room + 1)) - 1
    for j in range(len(lengths) - 1, -1, -1):
        left, many = min(there[j], room // lengths[j]), 1
        while left > 0 and not reach >> room & 1:
            many = min(many, left)
            trail.append((reach, j, many))
            reach |= reach << (many * lengths[j]) & mask
            left, many = left - many, many * 2
    full, out = reach.bit_length() - 1, Counter()
    for before, j, many in reversed(trail):
        if not before >> full & 1:
            out[j] += many
            full -= many * lengths[j]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Packing:
    """Fillings that together have exactly the pieces of the histogram (length: number of pieces)."""
    out = Packing()
    total = sum(length * n for length, n in histogram.items())
    whole = histogram.get(capacity, 0)
    if whole:
        out.fillings.append((((capacity, 1),), whole))
    rest = sorted((length, n) for length, n in histogram.items() if n > 0 and length < capacity)
    out.bound = -(-total // capacity)
    if not rest:
        return out
    lengths, there = np.array([x for x, _ in rest]), np.array([n for _, n in rest])
    sizes = lengths.tolist()
    solved, bound = _fractional(lengths, there, capacity, rounds)
    out.bound = max(out.bound, whole + int(np.ceil(bound - 1e-6)), whole - (-sum(there.tolist()) // (capacity // sizes[0])))
    full = {c: x for c, x in solved.items() if sum(a * sizes[j] for j, a in c) >= (1 - NEAR) * capacity}
    begun, left = Counter(), there.tolist()
    for c, x in sorted(full.items(), key=lambda y: (-y[1], y[0])):
        _take(begun, left, c, int(x))
    singles, rest_of = Counter(begun), list(left)
    for c, _ in sorted(full.items(), key=lambda y: (-(y[1] % 1), y[0])):
        _take(singles, rest_of, c, 1)
    found = singles + _filled(sizes, rest_of, capacity)
    if whole + found.total() > out.bound:
        ways = [found, begun + _filled(sizes, list(left), capacity), begun + _best_fit(sizes, left, capacity), _best_fit(sizes, there.tolist(), capacity)]
        found = min(ways, key=Counter.total)
    out.fillings += [(tuple((sizes[j], a) for j, a in c), n) for c, n in found.items()]
    return out


def _take(found: Counter, left: list[int], c: tuple[tuple[int, int], ...], most: int) -> None:
    n = min([most, *(left[j] // a for j, a in c)])
    if n > 0:
        found[c] += n
        for j, a in c:
            left[j] -= n * a


def _filled(sizes: list[int], left: list[int], capacity: int) -> Counter:
    """The longest piece and with it those that leave the least room, each such filling as often as it fits."""
    found: Counter = Counter()
    while any(left):
        longest = max(j for j, n in enumerate(left) if n)
        left[longest] -= 1
        c = _subset(sizes, left, capacity - sizes[longest])
        left[longest] += 1
        c[longest] += 1
        _take(found, left, tuple(sorted(c.items())), max(left))
    return found


def _best_fit(sizes: list[int], left: list[int], capacity: int) -> Counter:
    """Best-fit-decreasing: each piece goes where the least room is left; sequences that are filled alike are kept as one."""
    rooms: dict[int, Counter] = {capacity: Counter({(): sum(left)})}
    mask = 1 << capacity
    for j in range(len(sizes) - 1, -1, -1):
        n = left[j]
        while n:
            fits = mask >> sizes[j]
            room = sizes[j] + (fits & -fits).bit_length() - 1
            many = n if room < capacity else -(-n // (capacity // sizes[j]))
            c, there = next(iter(rooms[room].items()))
            many = min(many, there)
            rooms[room][c] -= many
            if rooms[room][c] == 0:
                del rooms[room][c]
                if not rooms[room]:
                    mask &= ~(1 << room)
            after = room - sizes[j]
            more = (*c[:-1], (j, c[-1][1] + 1)) if c and c[-1][0] == j else (*c, (j, 1))
            rooms.setdefault(after, Counter())[more] += many
            mask |= 1 << after
            n -= many
    found: Counter = Counter()
    for here in rooms.values():
        for c, n in here.items():
            if c:
                found[tuple(sorted(c))] += n
    return found


def _places(packing: Packing) -> np.ndarray:
    """Rows (length, first number, pieces of it in a sequence, first sequence, first offset), by length and number."""
    rows, next_number, sequence = [], Counter(), 0
    for filling, n in packing.fillings:
        offset = 0
        for length, a in reversed(filling):
            rows.append((length, next_number[length], a, sequence, offset))
            next_number[length] += n * a
            offset += length * a
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each piece: the document's id, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Every document has a piece, a null or empty text that of the id 0 alone. Offsets are gapless from 0 in each sequence.
    Repeated rows are packed as often as they are there; a null id stays null; other columns are not carried. An empty table
    gives an empty one. Texts are read once; the pieces are written to the shared folder, and pieces of one length are
    numbered in parts, so a length that a third of all pieces has is no single task. Texts come to Python as a whole.
    """
    cut = cut_pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), capacity=capacity, vocabulary=vocabulary, carry_text=False)
    pieces = written(cut.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity, rounds))
    parts = MORE_PARTS if sum(histogram.values()) > MANY else PARTS
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    numbered = _slots(dealt, ["length", "__part"], [F.col(c) for c in ("doc_id", "piece", "ids_crc32")])
    source = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "slot")
    made = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*source.schema.fields[:5], *made])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1 << 44)
        key = places[:, 0] * shift + places[:, 1]
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(key, length * shift + number, "right") - 1
            _, first, a, sequence, offset = places[at].T
            nth = number - first
            columns = [pa.array(sequence + nth // a), pa.array(offset + nth % a * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns], names=schema.fieldNames())

    return source.mapInArrow(place, schema).withColumnRenamed("doc_id", doc_id)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
