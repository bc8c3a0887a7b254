"""Canonical length-limited Huffman codes over token ids, in numpy.

encode() writes ids as one bit string with a bit offset every EVERY ids; decode() walks all those
stretches side by side, one table look-up an id.
"""

from __future__ import annotations

import numpy as np

MAX_BITS = 18
EVERY = 256


def added(counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """counts by id, with those of ids added."""
    own = np.bincount(ids, minlength=len(counts))
    own[: len(counts)] += counts
    return own


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each id under an optimal code of at most `most` bits (package-merge); 0 for ids without counts."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit into codes of {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    layers, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        layers.append(order < len(leaves))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    # Of each layer, from the last to the first, a prefix is taken: its leaves are the rarest ids.
    take, bits = 2 * len(used) - 2, np.zeros(len(used), dtype=np.uint8)
    for is_leaf in reversed(layers):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    lengths[used] = bits
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: shorter codes first, then by id."""
    out, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - last
        last = bits
        out[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return out


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every string of `bits` bits: the id that it begins with, and the bits of that id's code."""
    bits = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, bits - lengths[used].astype(np.int64))
    ids = np.zeros(1 << bits, dtype=np.uint32)
    ids[: spans.sum()] = np.repeat(used, spans)
    return ids, np.maximum(lengths[ids], 1), bits


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The bit string (big-endian words of 64 bits) and the bit offset of every `every`-th id."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.uint64)
    n, value = lengths[ids].astype(np.int64), code[ids]
    ends = np.cumsum(n)
    starts = ends - n
    word, room = starts >> 6, 64 - (starts & 63) - n
    left = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros((int(ends[-1]) >> 6) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.bitwise_or.reduceat(left, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words[: (int(ends[-1]) + 63) // 64].astype(">u8").tobytes(), starts[::every].astype(np.uint64)


def decode(bits: bytes, offsets: np.ndarray, count: int, decoder: tuple[np.ndarray, np.ndarray, int], every: int = EVERY) -> np.ndarray:
    """The ids of encode()'s output; each stretch between offsets is read on its own."""
    ids, sizes, width = decoder
    halves = np.concatenate([np.frombuffer(bits, dtype=">u4").astype(np.uint64), np.zeros(2, dtype=np.uint64)])
    pairs = (halves[:-1] << np.uint64(32)) | halves[1:]
    at, mask = offsets.astype(np.int64), np.uint64((1 << width) - 1)
    out = np.zeros((min(every, count) if count else 0, len(at)), dtype=np.uint32)
    live = len(at)
    for k in range(len(out)):
        if k == count - (len(at) - 1) * every:
            live = len(at) - 1  # the last stretch may be short
            at = at[:live]
        found = ((pairs[at >> 5] >> (64 - width - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[k, :live] = ids[found]
        at = at + sizes[found]
    return out.T.reshape(-1)[:count]
