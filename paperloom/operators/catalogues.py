"""Message catalogues: nested JSON flattened to paths, parity between languages, placeholders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

PLURAL = r"_(zero|one|two|few|many|other)$"


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def leaves(tree: pd.Series) -> pd.Series:
    """All leaves of a JSON object with their dotted paths; lists are leaves."""

    def walk(node: dict, prefix: str):
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                yield from walk(value, path)
            else:
                yield {"path": path, "value": value if isinstance(value, str) else json.dumps(value)}

    return tree.map(lambda x: list(walk(json.loads(x), "")))


def flatten(catalogues: DataFrame) -> DataFrame:
    """From (lang, body): rows (lang, path, value)."""
    return catalogues.select("lang", F.inline(leaves("body")))


def base_key(path: Column) -> Column:
    return F.regexp_replace(path, PLURAL, "")


def parity(flat: DataFrame, reference: str) -> DataFrame:
    """Base keys that a language lacks or has beyond the reference: rows (lang, key, difference)."""
    keys = flat.select("lang", base_key(F.col("path")).alias("key")).distinct()
    wanted = keys.where(F.col("lang") == reference).select("key")
    others = keys.where(F.col("lang") != reference)
    # The list of languages is the catalogue's own, a row each.
    pairs = others.select("lang").distinct().crossJoin(wanted)
    missing = pairs.join(others, ["lang", "key"], "left_anti").withColumn("difference", F.lit("missing"))
    return missing.unionByName(others.join(wanted, "key", "left_anti").select("lang", "key", F.lit("extra").alias("difference")))


def placeholders(value: Column) -> Column:
    """The sorted names in {{...}}."""
    return F.array_sort(F.regexp_extract_all(value, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))
