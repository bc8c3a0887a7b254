"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import common, exact_dedup, mixing, packing, quality_rules, simhash_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null and empty texts among them. Repeated rows are judged alike; other columns, nulls and ids of any kind stay as they are."""
    return quality_rules.good_rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts. A null text equals an empty one; a null id stays only among null ids; of rows that repeat id and text, one stays."""
    return exact_dedup.first_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; null and repeated ids as in drop_copies(). Texts without words are one group."""
    return simhash_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that sources meet their target weights. Null sources are one source, the last; rows without words follow their source's whole repetitions."""
    return mixing.mixed_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts token ids into pieces and packs them into windows. A null text is its end token alone; a very long text is as many pieces as it needs. An empty table gives none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. A stage's table is dropped once the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, name)
        docs = common.written(stage(spark, docs, sf_dir), name, path)
        if before:
            common.drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
