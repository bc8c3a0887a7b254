"""LM scoring: a trigram model in Elias-Fano tries, one per shard, queried block by block.

Words are 64-bit hashes, so no vocabulary has to be agreed on or broadcast; the successors of a
context are told apart by 32 bits. The work is bulk arrays that Spark shuffles twice:

1. Documents become blocks (a table in the shared folder, bucketed by block, so that it meets the
   answers without a shuffle of its own): the block's words, and per document its words as places
   in that list.
2. Each block sends every shard its distinct triples of words with their training counts, as a small
   tree. A shard is a part of all first words; first words with more than a thousandth of all tokens
   are spread over all shards by their second words, and pairs as frequent by their third, so no
   shard grows with the most frequent word or pair. There are at most 2 / SHARE of either.
3. A shard adds up the counts, builds its trie and answers each block: training counts of words, and
   the quantised probabilities of pairs and triples.
4. Blocks meet their answers and sum over documents.

The model is p(w | u v) = (c(u v w) + MU_3 p(w | v)) / (c(u v) + MU_3), with
p(w | v) = (c(v w) + MU_2 p(w)) / (c(v) + MU_2) and p(w) = (c(w) + 1) / (N + V + 1): Dirichlet priors
round the next shorter context. V is counted over all blocks. Texts start with two marks and end with
one, so each token has two words before it. Codes hold c(u v w) / (c(u v) + MU_3), MU_3 / (c(u v) + MU_3)
and c(v w) / (c(v) + MU_2), in codebooks whose ends follow from N alone: a score doesn't depend on how
blocks and shards are laid out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, scratch_path, written
from .elias_fano import LEVELS, SUCCESSOR_BITS, Trie, codebook
from .tokens import text_ranges, utf8

MU_2, MU_3 = 20.0, 10.0
#: Bytes of text in a block, and tokens that a shard takes about.
BLOCK_BYTES = 8_000_000
SHARD_TOKENS = 2_000_000
#: Words and pairs with this share of all training tokens and more are spread over all shards.
SHARE = 0.001

#: Spark refuses tables of more buckets.
MAX_BUCKETS = 100_000

#: Hashes of the two marks before a text and of its end; no word holds white space.
FIRST, START, END = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" first", b" start", b" end"))
#: Their places in a block's words.
_FIRST, _START, _END, _WORDS = 0, 1, 2, 3
_LOW = np.uint64((1 << SUCCESSOR_BITS) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_places(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts as places in a list of distinct words (between ASCII white space, A-Z lower-cased), the list, and the number of words of each text."""
    data, ends = utf8(texts)
    starts = np.concatenate([[0], ends[:-1]])
    solid = ~_WHITE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    # A text begins a word where it isn't white, also right after another text.
    inner = starts[starts < ends]
    begins[inner] = solid[inner]
    at = np.flatnonzero(begins)
    counts = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, dtype=np.int64), [], counts
    kept = _LOWER[data[solid]]
    bounds = np.append(np.cumsum(solid)[at] - 1, len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), counts


def _blocks(source: DataFrame, block_bytes: int) -> DataFrame:
    kind = source.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for whole in _gathered(batches, block_bytes):
            for first, last in text_ranges(whole.column("text"), block_bytes):
                ids, words, sizes = word_places(whole.column("text")[first:last])
                held = whole.column("held_out")[first:last]
                learnt = ~held.to_numpy(zero_copy_only=False).astype(bool)
                train = np.bincount(ids[np.repeat(learnt, sizes)] + _WORDS, minlength=len(words) + _WORDS)
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
                sizes = sizes + 1
                row = pa.array([0, last - first], pa.int32())
                bits = lambda values, kind: pa.array([_packed(np.ascontiguousarray(values, dtype=kind).tobytes())], pa.binary())
                number_of = lambda n: pa.array([int(n)], pa.int64())
                columns = {
                    "block": number_of((task << 32) | number), "doc_ids": pa.ListArray.from_arrays(row, whole.column("doc_id")[first:last]), "held_out": bits(~learnt, "<u1"),
                    "sizes": bits(sizes, "<u4"), "low": bits((ids + _WORDS) & 0xFFFF, "<u2"), "high": bits((ids + _WORDS) >> 16, "<u2"),
                    "hashes": bits(np.concatenate([[FIRST, START, END], hashes]), "<u8"), "train": bits(train, "<u4"),
                    "train_tokens": number_of(sizes[learnt].sum()), "train_docs": number_of(learnt.sum()), "tokens": number_of(sizes.sum()),
                }
                number += 1
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(encoded, f"block long, doc_ids array<{kind}>, held_out binary, sizes binary, low binary, high binary, hashes binary, train binary, train_tokens long, train_docs long, tokens long")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts hold about `size` bytes, so that a task's blocks are full."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column("text").nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


_CODEC = pa.Codec("zstd", compression_level=3)


def _packed(held: bytes) -> bytes:
    """Compressed bytes behind their plain length: what shuffles and tables write of these columns is small already."""
    return len(held).to_bytes(8, "little") + _CODEC.compress(held, asbytes=True)


def _unpacked(held: bytes) -> bytes:
    return _CODEC.decompress(held[8:], int.from_bytes(held[:8], "little"), asbytes=True)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows of blocks or answers, with binary columns unpacked; doc_ids stay behind."""
    columns = {name: batch.column(name) for name in batch.schema.names if name != "doc_ids"}
    for k in range(batch.num_rows):
        yield {name: _unpacked(c[k].as_py()) if pa.types.is_binary(c.type) else c[k].as_py() for name, c in columns.items()}


def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low


class _Sequence:
    """A block's triples of words, one per token and one more per text, and the distinct pairs and triples among them."""

    def __init__(self, row: dict):
        self.hashes, self.sizes = np.frombuffer(row["hashes"], dtype="<u8"), np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64)
        self.held = np.frombuffer(row["held_out"], dtype="<u1").astype(bool)
        ids = np.frombuffer(row["low"], dtype="<u2").astype(np.int32) | (np.frombuffer(row["high"], dtype="<u2").astype(np.int32) << 16)
        # first, start, the words, end, end.
        after = np.cumsum(self.sizes + 3)
        before = after - self.sizes - 3
        line = np.full(int(after[-1]) if len(after) else 0, -1, dtype=np.int32)
        line[before], line[before + 1], line[after - 1], line[after - 2] = _FIRST, _START, _END, _END
        line[line < 0] = ids
        self.begins = before - 2 * np.arange(len(before))
        each = np.ones(len(line), dtype=bool)
        each[after - 1] = each[after - 2] = False
        at = np.flatnonzero(each)
        self.u, self.v, self.w = line[at], line[at + 1], line[at + 2]
        self.learnt = np.repeat(~self.held, self.sizes + 1)
        #: The last triple of a text scores nothing; it holds the pair of the last word and the end.
        self.padding = self.begins + self.sizes

    def fold(self) -> None:
        """Finds the distinct pairs (pair_u, pair_v) and triples (triple_pair, triple_w), and those of each token."""
        pairs, self.pair_of = np.unique(_key(self.u, self.v), return_inverse=True)
        self.pair_u, self.pair_v = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)
        triples, self.triple_of = np.unique(_key(self.pair_of, self.w), return_inverse=True)
        self.triple_pair, self.triple_w = (triples >> 32).astype(np.int32), triples.astype(np.int32)


@dataclass(frozen=True)
class _Frequent:
    """Training counts of what is spread over all shards: words by hash, and pairs by the hashes of both."""

    words: dict[int, int]
    pairs: dict[tuple[int, int], int]

    def word_marks(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, np.fromiter(self.words, dtype=np.uint64, count=len(self.words)))

    def pair_marks(self, hashes: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which pairs of places (ascending by u, then v) are frequent."""
        members = np.array(sorted({h for pair in self.pairs for h in pair}), dtype=np.uint64)
        place = {int(hashes[k]): int(k) for k in np.flatnonzero(np.isin(hashes, members))}
        wanted = np.array(sorted((place[a] << 32) | place[b] for a, b in self.pairs if a in place and b in place), dtype=np.int64)
        return np.isin(_key(u, v), wanted)


class _Routes:
    """Which shard each triple of a block belongs to: triples by shard, inside a shard by word, pair and third word."""

    def __init__(self, block: _Sequence, shards: int, frequent: _Frequent):
        hashes, pair_hash = block.hashes, block.hashes[block.pair_u]
        pair_hash = pair_hash ^ np.where(frequent.word_marks(hashes)[block.pair_u], hashes[block.pair_v] * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        spread = frequent.pair_marks(hashes, block.pair_u, block.pair_v)
        mixed = pair_hash[block.triple_pair] ^ np.where(spread[block.triple_pair], hashes[block.triple_w] * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
        shard = (mixed >> np.uint64(20)) % np.uint64(shards)
        self.order = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
        self.shard = shard[self.order].astype(np.int64)
        pair = block.triple_pair[self.order]
        heads = self._heads(self.shard, pair)
        self.pair, self.pair_shard, self.triples_of_pair = pair[heads], self.shard[heads], np.diff(np.append(heads, len(pair)))
        heads = self._heads(self.pair_shard, block.pair_u[self.pair])
        self.word, self.word_shard, self.pairs_of_word = block.pair_u[self.pair[heads]], self.pair_shard[heads], np.diff(np.append(heads, len(self.pair)))

    @staticmethod
    def _heads(shard: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, dtype=int)

    def parts(self) -> list[tuple[int, slice, slice, slice]]:
        """(shard, its words, its pairs, its triples)."""
        found = np.unique(self.shard)
        bounds = [np.searchsorted(level, [found, found + 1]).T.tolist() for level in (self.word_shard, self.pair_shard, self.shard)]
        return [(int(s), *[slice(*b[i]) for b in bounds]) for i, s in enumerate(found)]


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned values in as few bytes each as the largest needs; their number tells which on reading."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _wide(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, dtype=f"<u{len(held) // n if n else 1}").astype(np.int64)


_MESSAGE = "shard int, block long, n_words int, n_pairs int, n_triples int, words binary, pairs_of_word binary, pairs binary, triples_of_pair binary, triples binary, counts binary"
_MESSAGE_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n_words", pa.int32()), ("n_pairs", pa.int32()), ("n_triples", pa.int32())] + [(n, pa.binary()) for n in ("words", "pairs_of_word", "pairs", "triples_of_pair", "triples", "counts")])
_ANSWER = "block long, shard int, totals binary, pair_codes binary, rest_codes binary, triple_codes binary"
_ANSWER_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("totals", pa.binary()), ("pair_codes", pa.binary()), ("rest_codes", pa.binary()), ("triple_codes", pa.binary())])


def codebook_ends(tokens: int) -> list[tuple[float, float]]:
    """The logarithms between which the probabilities of pairs, the weights they leave and the probabilities of triples lie: every count is 1 to the number of training tokens."""
    most = max(1, tokens)
    return [tuple(float(np.log10(x)) for x in ends) for ends in ((1 / (most + MU_2), most / (most + MU_2)), (MU_3 / (most + MU_3), MU_3 / (1 + MU_3)), (1 / (most + MU_3), most / (most + MU_3)))]


def _planes(codes: np.ndarray) -> bytes:
    """Codes byte by byte, all low bytes first, which pack better."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(len(codes), -1).T).tobytes()


def _codes(held: bytes, levels: int) -> np.ndarray:
    width = 1 if levels < 256 else 2
    return np.ascontiguousarray(np.frombuffer(held, dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _messages(shards: int, frequent: _Frequent):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = _Sequence(row)
                block.fold()
                counts = np.bincount(block.triple_of[block.learnt], minlength=len(block.triple_w))
                routes = _Routes(block, shards, frequent)
                ids = (block.hashes & _LOW).astype("<u4")
                second, third, counts = ids[block.pair_v[routes.pair]], ids[block.triple_w[routes.order]], counts[routes.order]
                yield pa.RecordBatch.from_pylist([
                    {
                        "shard": s, "block": row["block"], "n_words": a.stop - a.start, "n_pairs": b.stop - b.start, "n_triples": c.stop - c.start,
                        "words": block.hashes[routes.word[a]].tobytes(), "pairs_of_word": _packed(_narrow(routes.pairs_of_word[a])), "pairs": _packed(second[b].tobytes()),
                        "triples_of_pair": _packed(_narrow(routes.triples_of_pair[b])), "triples": _packed(third[c].tobytes()), "counts": _packed(_narrow(counts[c])),
                    } for s, a, b, c in routes.parts()
                ], schema=_MESSAGE_ARROW)

    return send


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with an inverse of 32 bits."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, inverse.astype(np.int32)


class Shard:
    """Adds up the trees of a shard's messages, and holds the trie of what was learnt."""

    def __init__(self, words: np.ndarray, pairs_of_word: np.ndarray, pair_ids: np.ndarray, triples_of_pair: np.ndarray, triple_ids: np.ndarray, counts: np.ndarray, frequent: _Frequent, tokens: int, levels: int = LEVELS):
        bits = np.uint64(SUCCESSOR_BITS)
        key = lambda rank, ids: (rank.astype(np.uint64) << bits) | ids
        parts = lambda keys: ((keys >> bits).astype(np.int64), keys & _LOW)
        self.words, self.word_of = np.unique(words, return_inverse=True)
        pairs, self.pair_of = _distinct(key(np.repeat(self.word_of, pairs_of_word), pair_ids))
        triples, self.triple_of = _distinct(key(np.repeat(self.pair_of, triples_of_pair), triple_ids))
        (word, second), (pair, third) = parts(pairs), parts(triples)
        of_triple = np.bincount(self.triple_of, weights=counts, minlength=len(triples)).astype(np.int64)
        of_pair = np.bincount(pair, weights=of_triple, minlength=len(pairs)).astype(np.int64)
        rank = {h: k for k, h in enumerate(self.words.tolist()) if h in frequent.words}
        for (u, v), n in frequent.pairs.items():
            if u in rank:
                wanted = np.uint64((rank[u] << SUCCESSOR_BITS) | (v & int(_LOW)))
                at = int(np.searchsorted(pairs, wanted))
                if at < len(pairs) and pairs[at] == wanted:
                    of_pair[at] = n
        self.totals = np.bincount(word, weights=of_pair, minlength=len(self.words)).astype(np.int64)
        for h, k in rank.items():
            self.totals[k] = frequent.words[h]
        # Only what was learnt goes into the trie; everything asked for is then looked up in it.
        known_word, known_pair, known = self.totals > 0, of_pair > 0, of_triple > 0
        new_word, new_pair = np.cumsum(known_word) - 1, np.cumsum(known_pair) - 1
        self.trie = Trie(
            self.words[known_word], new_word[word[known_pair]], second[known_pair], new_pair[pair[known]], third[known],
            of_pair[known_pair] / (self.totals[word[known_pair]] + MU_2), MU_3 / (of_pair[known_pair] + MU_3), of_triple[known] / (of_pair[pair[known]] + MU_3), codebook_ends(tokens), levels,
        )
        at_pair = self.trie.pairs.find(self.trie.rank(self.words)[word], second)
        at_triple = self.trie.triples.find(at_pair[pair], third)
        self.pair_codes, self.rest_codes, self.triple_codes = self.trie.code(0, at_pair), self.trie.code(1, at_pair), self.trie.code(2, at_triple)


def _answers(frequent: _Frequent, tokens: int, levels: int):
    def answer(rows: pa.Table) -> pa.Table:
        n_words, n_pairs, n_triples = (rows.column(n).to_numpy() for n in ("n_words", "n_pairs", "n_triples"))
        held = {n: [_unpacked(b) for b in rows.column(n).to_pylist()] for n in ("pairs_of_word", "pairs", "triples_of_pair", "triples", "counts")}
        held["words"] = rows.column("words").to_pylist()
        joined = lambda name, kind: np.frombuffer(b"".join(held[name]), dtype=kind)
        narrow = lambda name, sizes: np.concatenate([_wide(b, n) for b, n in zip(held[name], sizes.tolist(), strict=True)])
        ids = lambda name: joined(name, "<u4").astype(np.uint64)
        shard = Shard(joined("words", "<u8"), narrow("pairs_of_word", n_words), ids("pairs"), narrow("triples_of_pair", n_pairs), ids("triples"), narrow("counts", n_triples), frequent, tokens, levels)
        held.clear()
        totals, pair, rest, triple = shard.totals[shard.word_of], shard.pair_codes[shard.pair_of], shard.rest_codes[shard.pair_of], shard.triple_codes[shard.triple_of]
        a, b, c = (np.concatenate([[0], np.cumsum(n)]).tolist() for n in (n_words, n_pairs, n_triples))
        blocks, number = rows.column("block").to_pylist(), rows.column("shard").to_pylist()
        return pa.Table.from_pylist([
            {"block": blocks[i], "shard": number[i], "totals": _packed(_narrow(totals[a[i] : a[i + 1]])), "pair_codes": _packed(_planes(pair[b[i] : b[i + 1]])), "rest_codes": _packed(_planes(rest[b[i] : b[i + 1]])), "triple_codes": _packed(_planes(triple[c[i] : c[i + 1]]))}
            for i in range(len(blocks))
        ], schema=_ANSWER_ARROW)

    return answer


def _summed(shards: int, frequent: _Frequent, n: int, docs: int, vocabulary: int, levels: int):
    """Sums over documents."""
    books = [codebook(ends, nothing, levels) for ends, nothing in zip(codebook_ends(n), (0.0, 1.0, 0.0), strict=True)]

    def total(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        # Each group is one block.
        block = _Sequence(next(_rows(blocks)))
        block.fold()
        routes = _Routes(block, shards, frequent)
        said = {row["shard"]: row for row in _rows(answers)}
        count = np.zeros(len(block.hashes), dtype=np.int64)
        pair, rest, triple = np.zeros(len(block.pair_u)), np.ones(len(block.pair_u)), np.zeros(len(block.triple_w))
        for s, a, b, c in routes.parts():
            row = said[s]
            count[routes.word[a]] = _wide(row["totals"], a.stop - a.start)
            pair[routes.pair[b]] = books[0][_codes(row["pair_codes"], levels)]
            rest[routes.pair[b]] = books[1][_codes(row["rest_codes"], levels)]
            triple[routes.order[c]] = books[2][_codes(row["triple_codes"], levels)]
        as_context = count.copy()
        count[_FIRST], count[_START], count[_END] = 0, 0, docs
        single = (count + 1) / (n + vocabulary + 1)
        given_one = pair + MU_2 / (as_context[block.pair_u] + MU_2) * single[block.pair_v]
        # The pair of a triple's last two words is the next triple's first; a text's last triple has none and scores nothing.
        following = np.append(block.pair_of[1:], 0)
        p = np.minimum(1.0, triple[block.triple_of] + rest[block.pair_of] * given_one[following])
        by_token = np.stack([np.log10(p), np.log10(single[block.w]), count[block.w] > 0])
        by_token[:, block.padding] = 0
        score, base, known = np.add.reduceat(by_token, block.begins, axis=1)
        ids = blocks.column("doc_ids").combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(block.held), pa.array(block.sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return total


def _frequent(blocks: DataFrame, n: int, docs: int) -> _Frequent:
    """Words and pairs with SHARE of all training tokens, with their exact counts.

    One with that share holds half of it in blocks where it has at least half of it; those sums pick
    at most 2 / SHARE candidates, which a second pass counts in all blocks.
    """

    def words_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["hashes"], dtype=np.int64), np.frombuffer(row["train"], dtype="<u4").astype(np.int64)

    def pairs_of(words: np.ndarray):
        def counted(row: dict) -> tuple[np.ndarray, np.ndarray]:
            block = _Sequence(row)
            mark = np.isin(block.hashes.view(np.int64), words)[block.u] & block.learnt
            pairs, found = np.unique(_key(block.u[mark], block.v[mark]), return_counts=True)
            return np.stack([block.hashes[pairs >> 32], block.hashes[pairs & 0xFFFFFFFF]], axis=1).view(np.int64).reshape(-1, 2), found

        return counted

    def exact(rows: DataFrame, counted, keys: list[str]) -> list:
        """Rows (keys, n): candidates by a first pass, counted in a second one."""

        def run(keep):
            def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in given:
                    for row in _rows(batch):
                        ids, found = counted(row)
                        kept = keep(ids, found, row)
                        own = ids[kept].reshape(-1, len(keys))
                        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(own[:, k])) for k in range(len(keys))], pa.array(found[kept])], names=[*keys, "n"])

            schema = ", ".join(f"{k} long" for k in [*keys, "n"])
            return rows.mapInArrow(batches, schema).groupBy(*keys).agg(F.sum("n").alias("n"))

        top = run(lambda ids, found, row: found >= max(1, SHARE / 2 * row["train_tokens"])).where(F.col("n") >= SHARE / 2 * n).collect()
        chosen = {tuple(r[k] for k in keys) for r in top}
        if not chosen:
            return []
        inside = lambda ids, found, row: np.fromiter((tuple(i) in chosen for i in ids.reshape(-1, len(keys)).tolist()), dtype=bool, count=len(ids))
        return run(inside).collect()

    unsigned = lambda h: h & 0xFFFFFFFFFFFFFFFF
    words = exact(blocks.select("hashes", "train", "train_tokens"), words_of, ["hash"])
    marks = np.array([r["hash"] for r in words] + [int(h) - (1 << 64 if h >> np.uint64(63) else 0) for h in (FIRST, START)], dtype=np.int64)
    pairs = exact(blocks.select("hashes", "sizes", "held_out", "low", "high", "train_tokens"), pairs_of(marks), ["u", "v"])
    found = {unsigned(r["hash"]): r["n"] for r in words} | {int(FIRST): docs, int(START): docs}
    return _Frequent(found, {(unsigned(r["u"]), unsigned(r["v"])): r["n"] for r in pairs})


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words that a block's training rows hold; no block counts its marks."""
    for batch in batches:
        for row in _rows(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["hashes"], dtype=np.int64)[np.frombuffer(row["train"], dtype="<u4") > 0])], names=["hash"])


def lm_score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = "coalesce(crc32(CAST(doc_id AS STRING)) % 7 = 2, false)",
    block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS, levels: int = LEVELS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows that aren't held out (an expression over doc_id; a null doc_id is learnt from).
    Null and empty texts are the end token alone. Repeated rows count as often as they occur. Other
    columns are not read. An empty table gives an empty result; without training rows every count is 0.
    Probabilities are held in `levels` steps of the range that N allows, so the same rows get the same
    score however many blocks, shards and executors there are. A text is a part of one block, whole in memory.
    """
    spark = docs.sparkSession
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").selectExpr("doc_id", "text", f"{held_out} AS held_out")
    id_type = source.schema["doc_id"].dataType.simpleString()
    kept = scratch_path(spark, "lm-blocks")
    made = _blocks(source, block_bytes)
    # A bucket per input partition, as far as Spark lets tables have them.
    buckets = min(max(1, made.rdd.getNumPartitions()), MAX_BUCKETS)
    name = f"lm_blocks_{uuid.uuid4().hex}"
    try:
        made.write.option("compression", "zstd").option("path", kept).bucketBy(buckets, "block").saveAsTable(name)
        blocks = spark.table(name)

        sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("train_tokens", "train_docs", "tokens")]
        n, n_docs, tokens = blocks.agg(*sums).first()
        # Distinct training words and the end token.
        vocabulary = blocks.select("hashes", "train").mapInArrow(_trained, "hash long").distinct().count() + (n_docs > 0)
        frequent = _frequent(blocks, n, n_docs)

        # Shards and reducers grow with the tokens, a shard to a reducer.
        shards = max(spark.sparkContext.defaultParallelism, -(-tokens // shard_tokens))
        messages = blocks.select("block", "held_out", "sizes", "low", "high", "hashes").mapInArrow(_messages(shards, frequent), _MESSAGE)
        answers = messages.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_answers(frequent, n, levels), _ANSWER)
        asked = blocks.select("block", "doc_ids", "held_out", "sizes", "low", "high", "hashes").groupBy("block")
        total = _summed(shards, frequent, n, n_docs, vocabulary, levels)
        schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        rows = written(asked.cogroup(answers.repartition(buckets, "block").groupBy("block")).applyInArrow(total, schema), "lm-sums")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_table(spark, kept)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
