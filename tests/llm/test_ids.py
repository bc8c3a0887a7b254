"""Ids beyond 2**53 beside a null id, and ids that are text, come back as they went in."""

import public_tokenizers
import pytest

from paperloom.llm import exact_dedup, fill_middle, lm_score, mixing, packing, quality_rules, secret_scan, simhash_dedup, token_count, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

OPERATORS = {
    "quality_rules": quality_rules.quality_rules,
    "lm_score": lm_score.lm_score,
    "mixing": mixing.mix,
    "simhash": simhash_dedup.near_dedup,
    "packing": lambda docs: packing.pack(docs, BPE),
    "token_files": lambda docs: token_files.round_trip(docs, BPE),
    "exact_dedup": exact_dedup.exact_dedup,
    "token_count": lambda docs: token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")),
    "fill_middle": fill_middle.fill_in_middle,
    "secret_scan": lambda docs: secret_scan.find_secrets(docs, RANKS, public_tokenizers.PATTERN),
}
LARGE = [2**53 + 1, None, 2**53 + 3, 2**63 - 1, -(2**63), 0]


def key(i):
    return (i is not None, i or 0)


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_a_null_id(spark, name):
    docs = spark.createDataFrame([(i, f"a text of its own {n}", "s") for n, i in enumerate(LARGE)], "doc_id long, text string, source string").coalesce(1)
    assert sorted((r.doc_id for r in OPERATORS[name](docs).collect()), key=key) == sorted(LARGE, key=key)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"token_files"}))  # whose files hold integers
def test_text_ids(spark, name):
    ids = ["b", None, "a", "007", ""]
    docs = spark.createDataFrame([(i, f"a text of its own {n}", "s") for n, i in enumerate(ids)], "doc_id string, text string, source string").coalesce(1)
    assert sorted((r.doc_id for r in OPERATORS[name](docs).collect()), key=lambda i: (i is not None, i or "")) == [None, "", "007", "a", "b"]
