"""Token counts of whole texts by a byte-pair vocabulary with scores (a sentencepiece file), without making the ids.

A text is cut where no vocabulary piece can reach across: before each run of spaces. Arrow finds the
distinct pre-tokens of a batch; their characters become ragged numpy arrays of symbols, cut once more
between characters that no piece holds side by side. Then rounds of merges run over all sequences at
the same time: each applies its lowest-ranked pair wherever it occurs, until no pair is left, and the
symbols that survive are the tokens.

The vocabulary is not monotone: a merge can make a pair of a better rank than its own (`▁the` ranks
before `the`), and runs of spaces all share one rank, among which the leftmost pair goes first. So a
sequence stops, for the round, behind the first merge that makes a pair of the same or a better rank.
Sequences that are not done after ROUNDS rounds, which are long ones, go on in a heap in the same order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .tokens import text_ranges, utf8

#: Tokens beyond which a text is over the limit.
LIMIT = 4096
#: Rounds of simultaneous merges before the heap takes over.
ROUNDS = 96
#: Bytes of text that are counted at a time; a longer text is counted on its own.
BATCH_BYTES = 8_000_000
#: The mark that stands for a space in the vocabulary.
SPACE_MARK = "▁"

_NONE = np.iinfo(np.int32).max


class PieceCounter:
    """counts(texts) gives the length of what SentencePieceProcessor.encode(text) returns for each text.

    Only vocabularies of the kind are taken whose text isn't changed but for spaces: BPE, no character
    map, a space ahead of each text, runs of spaces kept, byte fallback, no symbols of the user's own.
    """

    def __init__(self, path: str, rounds: int = ROUNDS):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, trained, kinds = model.normalizer_spec, model.trainer_spec, model.SentencePiece
        plain = normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
        if trained.model_type != trained.BPE or not plain or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only BPE with byte fallback and an identity normalizer can be counted")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: pieces of the user's own or unused pieces can't be counted")
        scores = {p.piece.replace(SPACE_MARK, " "): p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(" " in piece.lstrip(" ") for piece in scores):
            raise ValueError(f"{path}: a piece goes on behind a space")
        self.rounds = rounds
        self._learn(scores)

    def _learn(self, scores: dict[str, float]) -> None:
        # Symbol 0 stands for all characters that no piece holds.
        chars = sorted({c for piece in scores for c in piece})
        symbols = {s: n for n, s in enumerate([*chars, *(p for p in scores if len(p) > 1)], start=1)}
        order = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.size = len(symbols) + 1
        self.letters = np.zeros(0x110000, dtype=np.int32)
        self.letters[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.weight = np.array([0] + [1 if s in scores else len(s.encode()) for s in symbols], dtype=np.int64)
        merges = {}
        for piece, score in scores.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left and right:
                    merges[left * self.size + right] = (order[score], symbols[piece])
        self.keys = np.array(sorted(merges), dtype=np.int64)
        self.ranks, self.made = (np.array([merges[k][part] for k in self.keys.tolist()], dtype=np.int32) for part in (0, 1))
        beside = {symbols[a] * self.size + symbols[b] for piece in scores for a, b in zip(piece, piece[1:], strict=False)}
        self.beside = np.array(sorted(beside), dtype=np.int64)
        self.merges: dict[int, tuple[int, int]] = merges

    def counts(self, texts: pa.Array | list[str]) -> np.ndarray:
        """The number of tokens of each text; null and empty texts have none."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE_MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, ends = utf8(texts)
        if not len(data):
            return np.zeros(len(ends), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        cut = data == 32
        cut[1:] &= data[:-1] != 32
        cut[starts[starts < ends]] = True
        at = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        each = self._of_pieces(found.dictionary)[found.indices.to_numpy()]
        before = np.concatenate([[0], np.cumsum(each)])
        return before[np.searchsorted(at, ends)] - before[np.searchsorted(at, starts)]

    def _of_pieces(self, pieces: pa.Array) -> np.ndarray:
        """The number of tokens of each distinct pre-token."""
        data, ends = utf8(pieces.cast(pa.large_string()))
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        heads = (data & 0xC0) != 0x80
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[heads]
        symbol = self.letters[points]
        counts = np.bincount(owner, weights=np.where(symbol == 0, _utf8_length(points), 0), minlength=len(ends)).astype(np.int64)
        held = symbol[:-1].astype(np.int64) * self.size + symbol[1:]
        joined = (owner[1:] == owner[:-1]) & _within(self.beside, held)[1]
        first = np.ones(len(symbol), dtype=bool)
        first[1:] = ~joined
        self._merge(symbol, np.flatnonzero(first), owner, counts)
        return counts

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols, _NONE if it can't be merged, and the symbol it makes."""
        place, known = _within(self.keys, left.astype(np.int64) * self.size + right)
        return np.where(known, self.ranks[place], _NONE), self.made[place]

    def _merge(self, symbol: np.ndarray, starts: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
        """Merges sequences of symbols, which begin at `starts`, and adds what survives to the counts of their owners."""
        sizes, owner = np.diff(starts, append=len(symbol)), owner[starts]
        rank, made = np.full(len(symbol), _NONE, dtype=np.int32), np.zeros(len(symbol), dtype=np.int32)
        inner = np.ones(len(symbol), dtype=bool)
        inner[starts + sizes - 1] = False
        inside = np.flatnonzero(inner)
        rank[inside], made[inside] = self._pairs(symbol[inside], symbol[inside + 1])
        for _ in range(self.rounds):
            best = np.minimum.reduceat(rank, starts) if len(starts) else np.zeros(0, dtype=np.int32)
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, sizes)
                np.add.at(counts, np.repeat(owner[over], sizes[over]), self.weight[symbol[gone]])
                symbol, rank, made = symbol[~gone], rank[~gone], made[~gone]
                sizes, owner, best = sizes[~over], owner[~over], best[~over]
            if not len(sizes):
                return
            starts = np.cumsum(sizes) - sizes
            sequence = np.repeat(np.arange(len(sizes)), sizes)
            at = self._chosen(symbol, rank, made, best, sequence)
            symbol[at] = made[at]
            kept = np.ones(len(symbol), dtype=bool)
            kept[at + 1] = False
            changed = np.zeros(len(symbol), dtype=bool)
            changed[at] = True
            symbol, rank, made, sequence, changed = symbol[kept], rank[kept], made[kept], sequence[kept], changed[kept]
            changed[:-1] |= changed[1:]  # the pair to the left, if it lies in the same sequence
            now = np.flatnonzero(changed)
            ahead = np.minimum(now + 1, len(symbol) - 1)
            new_rank, made[now] = self._pairs(symbol[now], symbol[ahead])
            rank[now] = np.where((ahead > now) & (sequence[ahead] == sequence[now]), new_rank, _NONE)
            sizes = np.bincount(sequence, minlength=len(sizes))
            starts = np.cumsum(sizes) - sizes
        for start, size, text in zip(starts.tolist(), sizes.tolist(), owner.tolist(), strict=True):
            counts[text] += self._by_heap(symbol[start : start + size].tolist())

    def _chosen(self, symbol: np.ndarray, rank: np.ndarray, made: np.ndarray, best: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Where the round merges: pairs of their sequence's best rank, leftmost first, none behind a merge that makes one as good."""
        at = np.flatnonzero(rank == best[sequence])
        breaks = np.ones(len(at), dtype=bool)
        breaks[1:] = np.diff(at) > 1
        run = np.flatnonzero(breaks)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
        mine, last = sequence[at], len(symbol) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        left = symbol[before]
        follows = np.zeros(len(at), dtype=bool)
        follows[1:] = np.diff(at) == 2
        left[follows] = made[at[np.flatnonzero(follows) - 1]]
        left_rank = np.where((at > 0) & (sequence[before] == mine), self._pairs(left, made[at])[0], _NONE)
        right_rank = np.where((at + 2 <= last) & (sequence[after] == mine), self._pairs(made[at], symbol[after])[0], _NONE)
        stops = np.flatnonzero(np.minimum(left_rank, right_rank) <= best[mine])
        if not len(stops):
            return at
        until = np.full(len(best), len(symbol))
        np.minimum.at(until, mine[stops], at[stops])
        return at[at <= until[mine]]

    def _by_heap(self, symbols: list[int]) -> int:
        """The number of tokens that a sequence ends with: best rank first, then leftmost."""
        merges, size = self.merges, self.size
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap = [(*found, k, k + 1) for k in range(len(symbols) - 1) if (found := merges.get(symbols[k] * size + symbols[k + 1]))]
        heap = [(rank, k, symbols[k], symbols[j], made) for rank, made, k, j in heap]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, made = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != left or j >= len(symbols) or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[k], symbols[j] = made, 0
            after[k] = after[j]
            if after[k] < len(symbols):
                before[after[k]] = k
            for one, two in ((before[k], k), (k, after[k])):
                if one >= 0 and two < len(symbols) and (found := merges.get(symbols[one] * size + symbols[two])):
                    heapq.heappush(heap, (found[0], one, symbols[one], symbols[two], found[1]))
        return int(self.weight[symbols].sum())


def _within(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted value in ascending keys (any place if it is missing), and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter per worker process and vocabulary file."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each row of docs.

    Nothing is shuffled and no row meets another. A null text counts as empty, which has no bytes and no
    tokens; repeated rows, null ids and ids of any type come back as they are, an empty table stays empty,
    other columns are ignored. Texts are counted whole: a batch takes memory for BATCH_BYTES of text or
    for its longest text. `model_path` must be readable on every executor.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_path)
        for batch in batches:
            ids, texts = batch.columns
            for start, stop in text_ranges(texts, BATCH_BYTES):
                part = texts.slice(start, stop - start)
                n = tokens.counts(part)
                columns = [ids.slice(start, stop - start), pc.binary_length(part).cast(pa.int64()), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    long = T.LongType()
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", long), T.StructField("n_tokens", long), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(counted, schema)
