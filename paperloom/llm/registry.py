"""The queries of this package and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import conversation_repair as _repair
from . import exact_dedup as _dedup
from . import fill_middle as _middle
from . import lm_score as _lm
from . import mixing as _mixing
from . import packing as _packing
from . import quality_rules as _rules
from . import rule_ensemble as _ensemble
from . import secret_scan as _secrets
from . import simhash_dedup as _simhash
from . import token_count as _counts
from . import token_files as _tokens
from . import url_filter as _urls
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules.quality_rules(table(spark, sf_dir, "documents")).drop("failed_rules")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.lm_score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.filter_urls(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair.repair(_repair.damaged(table(spark, sf_dir, "conversations")), "copies")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _middle.digests(_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_classifier, op2_quality_rules, op3_lm_score, op4_mixing, op5_url_filters, op6_simhash_dedup, op7_packing, op8_token_files, op9_exact_dedup, op10_secret_scan, op11_token_count, op12_conversation_repair, op13_fill_middle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": _rules.oracle_sql(),
        "op4_mixing": _mixing.ORACLE_SQL,
        "op5_url_filters": _urls.oracle_sql(),
        "op9_exact_dedup": _dedup.ORACLE_SQL,
        "op13_fill_middle": _middle.ORACLE_SQL,
    }
