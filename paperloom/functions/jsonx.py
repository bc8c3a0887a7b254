"""JSON in answers: strict parsing, object extraction, typed access to variants."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.I)
_JSON_FENCE = re.compile(r"```json\s*([\s\S]*?)```", re.I)


def _refuse(name: str):
    raise ValueError(name)


def strict_object(text: str) -> dict | None:
    """The object that a text is, by the letter of JSON: no NaN, nothing after it, no other top-level values."""
    try:
        found = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _balanced(text: str) -> list[dict]:
    """Top-level objects whose braces balance, from left to right; braces in strings don't count."""
    decoder, found, at = json.JSONDecoder(parse_constant=_refuse), [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            found.append(value)
        at = text.find("{", end)
    return found


def extract(raw: str) -> dict | None:
    """The whole text, else the last fenced block that is an object, else the last object in the prose."""
    text = raw.strip()
    if (whole := strict_object(text)) is not None:
        return whole
    for body in reversed(_FENCE.findall(text)):
        if (found := strict_object(body.strip())) is not None:
            return found
    return next(reversed(_balanced(text)), None)


def letter_block(markdown: str) -> dict | None:
    """The last json fence with a list of sections and a content or overall grade that is an object or a list."""
    for body in reversed(_JSON_FENCE.findall(markdown)):
        found = strict_object(body.strip())
        if found and isinstance(found.get("sections"), list) and any(isinstance(found.get(k), dict | list) for k in ("contentGrade", "overallGrade")):
            return found
    return None


def _as_json(found: dict | None) -> str | None:
    return None if found is None else json.dumps(found, ensure_ascii=False)


@F.pandas_udf(StringType())
def extract_object(raw: pd.Series) -> pd.Series:
    """extract() over a column, as JSON text."""
    return raw.map(lambda x: None if x is None else _as_json(extract(x)))


@F.pandas_udf(StringType())
def extract_letter(markdown: pd.Series) -> pd.Series:
    """letter_block() over a column, as JSON text."""
    return markdown.map(lambda x: None if x is None else _as_json(letter_block(x)))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ...; null for a missing member."""
    return F.schema_of_variant(value)


def string(value: Column, name: str) -> Column:
    """The member if it is a string, else null."""
    member = _member(value, name)
    return F.when(kind(member) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def boolean(value: Column, name: str) -> Column:
    return F.when(kind(_member(value, name)) == "BOOLEAN", F.try_variant_get(value, f"$.{name}", "boolean"))


def grade(value: Column, name: str = "grade") -> Column:
    """The member if it is a whole number from 1 to 6, else null."""
    number = F.when(kind(_member(value, name)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, f"$.{name}", "double"))
    return F.when((number >= 1) & (number <= 6) & (number == F.floor(number)), number.cast("int"))


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def objects(value: Column, name: str) -> Column:
    """The members of a list that are objects or lists, as array<variant>; empty if the member is no list."""
    listed = F.when(kind(_member(value, name)).startswith("ARRAY"), F.try_variant_get(value, f"$.{name}", "array<variant>"))
    return F.filter(F.coalesce(listed, F.array().cast("array<variant>")), is_object)
