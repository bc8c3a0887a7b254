"""Host probes as rows: what command-line tools print about graphics cards, parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.classify import gpu_vendor, round_half_up


def from_csv_probe(output: Column) -> Column:
    """struct(name, vram_mb, vendor) from `name, memory in MB`; null for blank output."""
    parts = F.split(F.trim(output), ",")
    name = F.trim(F.get(parts, 0))
    vram = F.coalesce(F.regexp_extract(F.coalesce(F.trim(F.get(parts, 1)), F.lit("0")), r"^\d+", 0).try_cast("int"), F.lit(0))
    return F.when(F.trim(output) != "", F.struct(F.when(name != "", name).otherwise("NVIDIA GPU").alias("name"), vram.alias("vram_mb"), F.lit("nvidia").alias("vendor")))


def from_json_probe(output: Column) -> Column:
    """The same from {"Name": ..., "VramBytes": ...}; null for blank or broken output."""
    parsed = F.from_json(output, "Name string, VramBytes double")
    name = F.trim(parsed["Name"])
    name = F.when(F.coalesce(F.length(name), F.lit(0)) > 0, name).otherwise("Unknown GPU")
    vram = round_half_up(F.coalesce(parsed["VramBytes"], F.lit(0.0)) / (1024 * 1024)).cast("int")
    return F.when(F.try_parse_json(output).isNotNull(), F.struct(name.alias("name"), vram.alias("vram_mb"), gpu_vendor(name).alias("vendor")))


def from_rocm_probe(output: Column) -> Column:
    """The same from a header line and a line with the memory in bytes; null without a second line. It names no card."""
    lines = F.split(F.trim(output), "\n")
    # The first digits of the line count, also where they belong to the device's name.
    vram = round_half_up(F.coalesce(F.regexp_extract(F.get(lines, 1), r"\d+", 0).try_cast("double"), F.lit(0.0)) / (1024 * 1024)).cast("int")
    return F.when(F.size(lines) > 1, F.struct(F.lit("AMD GPU").alias("name"), vram.alias("vram_mb"), F.lit("amd").alias("vendor")))


def biggest(adapters: Column) -> Column:
    """The same for array<struct(name, vram_bytes)>: the adapter with most memory, of equal ones the first; null for none."""
    ranked = F.transform(adapters, lambda a, k: F.struct(a["vram_bytes"].alias("vram_bytes"), (-k).alias("place"), a["name"].alias("name")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), round_half_up(best["vram_bytes"] / (1024 * 1024)).cast("int").alias("vram_mb"), gpu_vendor(best["name"]).alias("vendor")))


def first_gpu(*probes: Column) -> Column:
    """The first probe that found one."""
    return F.coalesce(*probes)
