import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import huffman, packing, token_files
from paperloom.llm.tokens import LONG_PIECE, WordEncoder

from .cases import SCHEMA, TEXTS, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  two  spaces ", "\n\n a\n b \n", "tab\tx\x1c y", "don't 's 12ab3!! -- ünï 日本 語 x", "<|endoftext|> hi", "a\xa0b  　 c", "trail \n", " lead", "\x00z z", "it's  'll", "x ɐ ǆ ß", "a ᠎ b"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_encoder_equals_the_library(tokenizer, spark, sf_dir):
    rng = random.Random(3)
    letters = [" ", " ", "\n", "a", "b", "'s", "é", "7", ".", "!!", "\t", "日", "\xa0", "  ", "The", " ", "\r\n"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(1500)] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    own = WordEncoder(PATH)
    ids, counts = own.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        at += n
    assert at == len(ids)


def test_every_character_in_varied_surroundings(tokenizer):
    """Characters below U+30000 beside white space, signs, letters, digits and marks, and long pieces."""
    rng = random.Random(8)
    before, after = ["a ", "a", " ", "", "1", "\n ", ". ", "'", "<|"], [" a", "a", " ", "", "1", " \n", ".", "'s", "|>"]
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [rng.choice(before) + c + rng.choice(after) for c in [*points[:0x3100], *rng.sample(points, 20_000)]]
    texts += ["x" * 300 + " y", "日本" * 200 + " z " + "é" * 500, " " * 500 + "a", " " * 500, "w" * 150_000, "see <|endoftext|> and <|x|> " * 3]
    own = WordEncoder(PATH, max_bytes=100_000)  # which makes it forget
    for first in range(0, len(texts), 5000):
        part = texts[first : first + 5000]
        ids, counts = own.encode(part)
        ends = np.cumsum(counts)
        for text, end, n, said in zip(part, ends.tolist(), counts.tolist(), tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert ids[end - n : end].tolist() == said.ids, text[:60]


def test_the_encoder_keeps_what_it_may(tokenizer):
    """What is kept is bounded by bytes, and long pieces and whole texts aren't kept at all."""
    own = WordEncoder(PATH, max_bytes=200_000)
    most = 0
    for n in range(40):
        own.encode([" ".join(f"word{n}x{i}" for i in range(300)), "字" * 5000 + str(n), f"<|{n} " * 200])
        most = max(most, own.pieces.held())
        assert all(len(p) <= LONG_PIECE for p in own.pieces.places)
    assert most < 400_000


def test_a_text_beyond_a_batch_and_a_block(spark, tokenizer):
    """Texts longer than a batch of the encoder, one of them a single word, among short ones."""
    rng = random.Random(2)
    texts = ["short", " ".join(rng.choices(["alpha", "beta", "gamma,", "δ", "\n"], k=900_000)), "q" * 120_000, "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_files(token_files.round_trip(docs, PATH).collect(), sorted(enumerate(texts)), tokenizer)
    check_packed(packing.pack(docs, PATH).collect(), dict(enumerate(texts)), tokenizer)


def whole(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def check_packed(rows, docs, tokenizer):
    """docs: {doc_id: text} of unrepeated rows."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc_id, pieces in by_doc.items():
        ids, at = whole(tokenizer, docs[doc_id], packing.END_ID), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert zlib.crc32(ids[p.start : at].tobytes()) == p.ids_crc32
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    return sum(r.length for r in rows) / packing.WINDOW / len(by_sequence)


def test_packing_holds_every_id_once_with_little_padding(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fill = check_packed(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    assert fill > 0.95


def test_packing_edge_cases(spark, tokenizer):
    rows = {r.doc_id: r.text for r in frame(spark, repeats=False).collect()}
    check_packed(packing.pack(frame(spark, repeats=False), PATH).collect(), rows, tokenizer)
    many = packing.pack(frame(spark, null_id=True), PATH).collect()
    assert sum(r.start == 0 for r in many) == frame(spark, null_id=True).count()
    assert len({(r.sequence_id, r.offset) for r in many}) == len(many)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_the_histogram_exactly(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(rng.choice((1, 3, 200, 20_000))):
        step = min(128, 1 + int(rng.expovariate(1 / rng.choice((5, 40, 90)))))
        histogram[step] = histogram.get(step, 0) + 1
    used = {}
    for steps, n in packing.plan(histogram):
        assert sum(steps) <= 128 and n > 0
        for s in steps:
            used[s] = used.get(s, 0) + n
    assert used == histogram


def test_nnls_against_known_solution():
    rng = np.random.default_rng(1)
    a = rng.random((20, 50))
    want = np.zeros(50)
    want[[3, 7, 20]] = 1, 2, 3
    x = packing.nnls(a, a @ want)
    assert (x >= 0).all() and np.allclose(a @ x, a @ want, atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 5000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 50_000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    assert lengths.max() <= huffman.MAX_BITS
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    bits, offsets = huffman.encode(ids, lengths, huffman.codes(lengths))
    assert (huffman.decode(bits, offsets, n, huffman.table(lengths)) == ids).all()


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free = huffman.code_lengths(counts, 18)
    assert (free * counts).sum() == 363  # a plain Huffman tree's cost: the sum of its inner nodes
    assert huffman.code_lengths(counts, 5).max() == 5
    assert sum(2.0 ** -int(x) for x in huffman.code_lengths(counts, 4)) == 1


def check_files(rows, docs, tokenizer):
    start = 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), docs, strict=True):
        ids = whole(tokenizer, text, token_files.END_ID)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_round_trip(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_files(token_files.round_trip(docs, PATH).collect(), sorted((r.doc_id, r.text) for r in docs.collect()), tokenizer)


def test_token_files_edge_cases(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 10)
    docs = frame(spark, repeats=False)
    check_files(token_files.round_trip(docs, PATH).collect(), sorted((r.doc_id, r.text) for r in docs.collect()), tokenizer)
    many = token_files.round_trip(frame(spark, null_id=True), PATH).collect()
    assert len(many) == frame(spark, null_id=True).count() and sum(r.doc_id is None and r.start == 0 for r in many) == 1
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert len(TEXTS) > 10
