"""Model catalogues as rows: what a server has installed and loaded, and the suggested ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.functions.patterns import SUGGESTED_MODELS

INSTALLED = "name string, size bigint, modified_at string"
LOADED = "name string, size bigint, size_vram bigint, expires_at string"
SUGGESTED = "name string, display_name string, size string, min_ram_gb int, min_vram_gb int, runtime string, budget boolean"


def _listed(spark: SparkSession, fetch: Callable[[], list[tuple]], schema: str) -> DataFrame:
    """What fetch() returns, as rows; a server that fails has none."""
    try:
        rows = list(fetch())
    except Exception:  # a catalogue is a nicety: any failure of its server means no rows
        rows = []
    return spark.createDataFrame(rows, schema).coalesce(1)


def installed(spark: SparkSession, fetch: Callable[[], list[tuple]]) -> DataFrame:
    """Rows (name, size, modified_at)."""
    return _listed(spark, fetch, INSTALLED)


def loaded(spark: SparkSession, fetch: Callable[[], list[tuple]]) -> DataFrame:
    """Rows (name, size, size_vram, expires_at)."""
    return _listed(spark, fetch, LOADED)


def suggested(spark: SparkSession) -> DataFrame:
    """The fixed relation of suggested models."""
    return spark.createDataFrame(list(SUGGESTED_MODELS), SUGGESTED).coalesce(1)
