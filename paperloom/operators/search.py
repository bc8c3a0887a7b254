"""Search over stored documents and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.patterns import PALETTE_LIMIT


def _has(column: str, needle: str) -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(needle)))


def history(docs: DataFrame, needle: str) -> DataFrame:
    """Documents whose filename or text holds the needle in any case; an empty needle keeps all. The needle isn't trimmed."""
    return docs.where(_has("filename", needle) | _has("text", needle)) if needle else docs


def palette(docs: DataFrame, needle: str, most: int = PALETTE_LIMIT) -> DataFrame:
    """The newest hits for a trimmed needle; none for a blank one."""
    needle = needle.strip()
    found = history(docs, needle) if needle else docs.where(F.lit(False))
    return found.orderBy(F.desc("created_at"), "id").limit(most)


def commands_and_documents(commands: DataFrame, docs: DataFrame, needle: str) -> DataFrame:
    """Commands (label, keywords) that match, then documents: rows (part, label, id)."""
    said = needle.strip().lower()
    hit = _has("label", said) | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(said)))
    first = commands.where(hit).select(F.lit(0).alias("part"), "label", F.lit(None).cast("long").alias("id"))
    return first.unionByName(palette(docs, needle).select(F.lit(1).alias("part"), F.col("filename").alias("label"), "id"))
