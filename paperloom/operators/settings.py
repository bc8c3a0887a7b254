"""Settings: repair of stored records field by field, merging, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import jsonx
from paperloom.functions.patterns import LANGUAGES, OCR_QUALITIES, THEMES

DEFAULTS = {"ollamaUrl": "http://localhost:11434", "selectedModel": "", "language": "de", "theme": "dark", "ocrLanguages": ["deu", "eng"], "ocrQuality": "balanced", "firstLaunchDone": False, "autoUpdateCheck": True}
_ENUMS = {"language": [c for c, *_ in LANGUAGES], "theme": list(THEMES), "ocrQuality": list(OCR_QUALITIES)}


def sanitised(raw: Column) -> Column:
    """struct of the eight fields and `repaired`: a field of the wrong type or value takes its default; a record that is no object, all defaults."""
    parsed = F.try_parse_json(raw)
    fields, bad = [], F.lit(False)
    for name, default in DEFAULTS.items():
        if isinstance(default, bool):
            value, fallback = jsonx.boolean(parsed, name), F.lit(default)
        elif isinstance(default, list):
            member = F.try_variant_get(parsed, f"$.{name}", "variant")
            listed = F.when(jsonx.kind(member).startswith("ARRAY"), F.try_variant_get(parsed, f"$.{name}", "array<variant>"))
            strings = F.forall(listed, lambda v: jsonx.kind(v) == "STRING")
            value, fallback = F.when(strings, F.transform(listed, lambda v: F.try_variant_get(v, "$", "string"))), F.array(*[F.lit(x) for x in default])
        else:
            said = jsonx.string(parsed, name)
            value, fallback = F.when(said.isin(*_ENUMS[name]), said) if name in _ENUMS else said, F.lit(default)
        bad = bad | value.isNull()
        fields.append(F.coalesce(value, fallback).alias(name))
    whole = F.coalesce(jsonx.kind(parsed).startswith("OBJECT"), F.lit(False))
    return F.struct(*fields, (whole & bad).alias("repaired"))


def defaults() -> Column:
    """What a reset leaves: a struct of the eight fields."""
    return F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(name) for name, v in DEFAULTS.items()])


def merged(current: Column, partial: Column) -> Column:
    """A map with partial's entries over current's."""
    keep = F.map_filter(current, lambda k, _: ~F.map_contains_key(partial, k))
    return F.map_concat(keep, partial)
