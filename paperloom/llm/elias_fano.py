"""Elias-Fano sequences and a three-level n-gram trie on top of them, in numpy.

A monotone sequence of n values below u takes about 2 + log2(u / n) bits a value: the low bits are
packed side by side, the high bits are written in unary. All queries work on arrays of positions
or values at once, and every array may lie in a memory-mapped file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of `bits` bits side by side in words of 64 bits."""
    words = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift > 64 - bits)
    words[word[over] + 1] |= values[over] >> (64 - shift[over])
    return words


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The position of the k-th set bit (from 0) of each word, halving the word six times."""
    at = np.zeros(len(words), dtype=np.uint64)
    rest = k.astype(np.uint64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((words >> at) & np.uint64((1 << half) - 1)).astype(np.uint64)
        up = rest >= low
        rest = np.where(up, rest - low, rest)
        at = np.where(up, at + np.uint64(half), at)
    return at.astype(np.int64)


class EliasFano:
    """A monotone sequence of unsigned 64-bit values; repeats are allowed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones)
        self.zeros = np.cumsum(64 - ones)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values ascending, all below universe."""
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        # A zero past the highest bucket, so that every bucket has an end.
        high = np.zeros(((universe - 1 >> bits) + n + 2) // 64 + 1, dtype=np.uint64)
        if n:
            word = ones >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(_ONE << (ones & 63).astype(np.uint64), first)
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        upper = np.where(shift > 0, self.low[word + 1] << ((64 - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        word = np.searchsorted(self.ones, i, side="right")
        before = np.where(word > 0, self.ones[word - 1], 0)
        at = word * 64 + _select_in_word(self.high[word], i - before)
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """The number of values whose high part is below h."""
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right")
        before = np.where(word > 0, self.zeros[word - 1], 0)
        at = word * 64 + _select_in_word(~self.high[word], k - before)
        return np.where(h > 0, at - k, 0)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x below the universe: the position of the first value >= x (n if none), and whether it equals x."""
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        at, end = self._bucket(h), self._bucket(h + 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        # A bucket's low parts ascend. Values crowd in some buckets, so each one is halved, not walked.
        stop = end.copy()
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            middle = (at[open_] + stop[open_]) >> 1
            below = self._low(middle) < want[open_]
            at[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < stop[open_]]
        equal = np.zeros(len(x), dtype=bool)
        inside = np.flatnonzero(at < end)
        equal[inside] = self._low(at[inside]) == want[inside]
        return at, equal

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high]


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in one memory-mapped temporary file, which has no name and goes with the last view."""
    with tempfile.TemporaryFile() as file:
        places = []
        for a in arrays:
            file.write(b"\0" * (-file.tell() % 8))
            places.append((file.tell(), len(a), a.dtype))
            file.write(a.tobytes())
        file.write(b"\0" * 8)
        file.flush()
        whole = np.memmap(file, dtype=np.uint8, mode="r")
    return [whole[at : at + n * dtype.itemsize].view(dtype) for at, n, dtype in places]


#: Bits of a successor's identifier; it is looked up among its context's successors only.
SUCCESSOR_BITS = 32
LEVELS = 1023


def _scale(logs: np.ndarray | tuple[float, float]) -> np.ndarray:
    """The square root of the negative logarithm: steps are finer where probabilities come near 1."""
    return np.sqrt(np.maximum(0.0, -np.asarray(logs)))


def quantised(values: np.ndarray, ends: tuple[float, float], levels: int = LEVELS) -> np.ndarray:
    """The place, from 1, of each probability above 0 in a codebook of `levels` entries, evenly spaced on the scale between the logarithms `ends`."""
    first, last = _scale(ends)
    place = np.rint((_scale(np.log10(values)) - first) / ((last - first) / (levels - 1) or 1))
    return (np.clip(place, 0, levels - 1) + 1).astype(np.uint8 if levels < 256 else np.uint16)


def codebook(ends: tuple[float, float], nothing: float, levels: int = LEVELS) -> np.ndarray:
    """The value of each code; code 0 is `nothing`."""
    return np.concatenate([[nothing], 10 ** -(np.linspace(*_scale(ends), levels) ** 2)])


class _Level:
    """Nodes below the nodes of another level: identifiers relative to the parent's rank, and pointers to each parent's first node."""

    def __init__(self, parents: int, rank: np.ndarray, ids: np.ndarray):
        """One entry per node, ascending by (rank of its parent, identifier)."""
        keys = (rank.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | ids
        pointers = np.searchsorted(rank, np.arange(parents + 1)).astype(np.uint64)
        self.keys = EliasFano.of(keys, max(1, parents) << SUCCESSOR_BITS)
        self.pointers = EliasFano.of(pointers, len(keys) + 1)

    def place(self, arrays: Iterator[np.ndarray]) -> None:
        """Takes over the mapped forms of its arrays, in the order of arrays()."""
        self.keys = EliasFano(self.keys.n, self.keys.low_bits, next(arrays), next(arrays))
        self.pointers = EliasFano(self.pointers.n, self.pointers.low_bits, next(arrays), next(arrays))

    def arrays(self) -> list[np.ndarray]:
        return [*self.keys.arrays(), *self.pointers.arrays()]

    def find(self, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The rank of each parent's successor with that identifier; -1 without one, or for parent -1."""
        out = np.full(len(parent), -1, dtype=np.int64)
        known = np.flatnonzero(parent >= 0)
        if len(known) and self.keys.n:
            own = parent[known]
            at, equal = self.keys.successor((own.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | ids[known])
            # The successor must lie in the parent's own range.
            hit = np.flatnonzero(equal)
            inside = at[hit] < self.pointers.access(own[hit] + 1).astype(np.int64)
            out[known[hit[inside]]] = at[hit[inside]]
        return out


class Trie:
    """Words (64-bit hashes), pairs below them and triples below those, in one memory-mapped file.

    A pair holds the code of its smoothed probability and that of the weight its own triples leave to
    shorter contexts; a triple holds the code of its probability.
    """

    def __init__(self, words: np.ndarray, pair_word: np.ndarray, pair_ids: np.ndarray, triple_pair: np.ndarray, triple_ids: np.ndarray, pair_p: np.ndarray, pair_rest: np.ndarray, triple_p: np.ndarray, ends: list[tuple[float, float]], levels: int = LEVELS):
        """words ascending; one entry per pair and per triple, ascending by (rank in the level above, identifier). ends: of the three codebooks."""
        one = EliasFano.of(words >> _ONE, 1 << 63)
        self.pairs, self.triples = _Level(len(words), pair_word, pair_ids), _Level(len(pair_ids), triple_pair, triple_ids)
        coded = [quantised(v, e, levels) for v, e in zip((pair_p, pair_rest, triple_p), ends, strict=True)]
        self.ends = ends
        arrays = iter(mapped([*one.arrays(), *self.pairs.arrays(), *self.triples.arrays(), *coded]))
        self.words = EliasFano(one.n, one.low_bits, next(arrays), next(arrays))
        self.pairs.place(arrays)
        self.triples.place(arrays)
        self.codes = list(arrays)

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Each word's rank, -1 if the trie lacks it. Words are told apart by 63 bits."""
        at, equal = self.words.successor(words >> _ONE)
        return np.where(equal, at, -1)

    def code(self, kind: int, rank: np.ndarray) -> np.ndarray:
        """Codes at ranks (0 for rank -1): kind 0 and 1 for pairs, 2 for triples."""
        held = self.codes[kind]
        return np.where(rank >= 0, held[np.maximum(rank, 0)], 0).astype(held.dtype) if len(held) else np.zeros(len(rank), dtype=held.dtype)
