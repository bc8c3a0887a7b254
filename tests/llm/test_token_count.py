"""Token counts against the library itself."""

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from paperloom.llm import token_count
from tests.llm import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute(texts):
    return [len(LIBRARY.encode(t)) if t else 0 for t in texts]


ODD = ["", " ", "  ", "\n", " a", "a ", "▁", "▁a ▁", "<s>x</s> <unk> <0x41>", "\x00", "　x\xa0y", "aaaaaaaa", "é", "\U0001f600\U0001f600", "ﬁ", " " * 37 + "the", "the" + " " * 5 + "\n" + " " * 17]


@pytest.mark.parametrize("rounds", [0, 1, 3, token_count.ROUNDS])
def test_equals_the_library_on_odd_and_random_texts(rounds):
    rng = random.Random(3)
    letters = ["a", "e", "th", "ing", "ion", " ", "  ", "\n", "\t", "1", "23", ".", "▁", "é", "да", "日本", "\U0001f600", "ก", "=", "//", "the", "\r\n"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)] + ["".join(map(chr, rng.choices([*range(0xD800), *range(0xE000, 0x11000)], k=30))) for _ in range(300)]
    assert token_count.PieceCounter(MODEL, rounds).counts(texts).tolist() == brute(texts)


def test_very_long_sequences_without_a_cut():
    rng = random.Random(4)
    texts = [" " * 200_001, "a" * 100_003, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ/+0123456789", k=200_000)), "theing" * 30_000, "w " * 100_000, "".join(rng.choices("日本語中国", k=50_000))]
    assert token_count.counter(MODEL).counts(texts).tolist() == brute(texts)


def test_equals_the_library_on_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    want = {i: (len(t.encode()), n, n > 4096) for i, t, n in zip(table["doc_id"], table["text"], brute(table["text"]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, MODEL).collect()} == want


def test_edge_rows_and_the_limit(spark):
    found = token_count.count_tokens(cases.frame(spark, null_id=True), MODEL, limit=3).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 3) for r, n in zip(cases.rows(null_id=True), brute([r[1] for r in cases.rows(null_id=True)]), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))
    assert token_count.count_tokens(cases.frame(spark).limit(0), MODEL).collect() == []
    assert token_count.count_tokens(spark.createDataFrame([("x", "the")], "doc_id string, text string"), MODEL).first().doc_id == "x"
