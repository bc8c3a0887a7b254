"""Exact dedup by a 128-bit content hash, with a comparison of the bytes inside each group.

Two passes: rows are grouped by hash and bytes (partial aggregation folds the copies of a partition
before the shuffle), and every row is then routed to its class by its digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, text_of


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), f"[{SPACE}]+", " ")


def _digest(t: Column) -> Column:
    """Never null, and said so: else the optimizer guards joins by a second pass over the texts."""
    return F.coalesce(F.sha2(t, 256), F.lit(""))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal normalised texts form a class; the row with the smallest id stays. Null
    and white-space-free empty texts are one class. Of rows that repeat id and text just one is
    kept. A null id stays only in a class without other ids. Other columns are not read. Texts
    with equal hashes but different bytes are different classes. A very long text is hashed and compared
    whole, once a row; copies inside a partition fold before they are shuffled.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    key = F.coalesce(F.unhex(F.md5("t")), F.lit(b"")).alias("content_key")

    # Copies fold inside each partition before the shuffle, so a hot group is a row per partition, not its rows.
    classes = (
        source.select("doc_id", "t", key)
        .groupBy("content_key", "t")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("content_key", _digest(F.col("t")).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("shared"))
    )
    copies = Window.partitionBy("doc_id", "content_key", "text_sha256").orderBy("doc_id")
    rows = source.select("doc_id", key, _digest(F.col("t")).alias("text_sha256")).withColumn("copy", F.row_number().over(copies))
    keep = F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.join(classes, ["content_key", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs that stays of each class, with all its columns.

    Rows meet their verdict by id and digest, in one key, by which they are shuffled once; of rows
    that repeat both, one passes. Null counts as empty text, and all empty texts are one class; a null id
    stays only in a class without other ids. Columns of any name pass through, nulls included; an empty
    table stays empty. A text of any length is shuffled once and compared in its digest and its bytes.
    """

    def key(doc_id: Column, digest: Column) -> Column:
        """Equal for rows that repeat both, never null."""
        return F.coalesce(F.concat(digest, F.coalesce(F.concat(F.lit(":"), doc_id.cast("string")), F.lit(""))), F.lit(""))

    keep = exact_dedup(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("row_key"))
    rows = docs.select(F.struct("*").alias("row"), key(F.col(f"`{id_col}`"), _digest(normalised(F.col(f"`{text_col}`")))).alias("row_key"))
    repeats = Window.partitionBy("row_key").orderBy("row_key")
    return rows.join(keep, "row_key", "left_semi").withColumn("repeat", F.row_number().over(repeats)).where("repeat = 1").select("row.*")


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{SPACE}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)"""
