"""Column functions over times, ids and error chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


def utc(ts: Column) -> Column:
    """An instant's date and time in UTC, as a timestamp without time zone, whatever the session's zone is: counted from the epoch, so no hour is skipped or told twice."""
    seconds = (F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_ms(ts: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds."""
    told = F.translate(F.substring(utc(ts).cast("string"), 1, 19), " ", "T")
    return F.concat(told, F.lit("."), F.lpad(F.pmod(F.unix_millis(ts.cast("timestamp")), F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def from_iso(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))


def day_key(ts: Column) -> Column:
    """The day in UTC."""
    return F.substring(utc(ts).cast("string"), 1, 10)


def german_short(ts: Column) -> Column:
    """dd.mm.yyyy, hh:mm."""
    return F.date_format(ts, "dd.MM.yyyy, HH:mm")


def german_long(ts: Column) -> Column:
    """d. month yyyy um hh:mm."""
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts) - 1)
    return F.concat(F.dayofmonth(ts).cast("string"), F.lit(". "), month, F.date_format(ts, " yyyy 'um' HH:mm"))


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def derived_id(*parts: Column) -> Column:
    """A UUID-shaped id from the parts' digest: the same on every run."""
    digest = F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)
    cut = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def gigabytes(size: Column) -> Column:
    """Bytes as GB with one place."""
    return F.round(size / (1024 * 1024 * 1024), 1)


def error_metadata(error: Column) -> Column:
    """struct(error, name, cause_message, cause_name, cause_code) from a JSON error whose cause is one level deep: an object or a plain value."""
    parsed = F.try_parse_json(error)
    cause = F.try_variant_get(parsed, "$.cause", "variant")
    nested = F.coalesce(F.schema_of_variant(cause).startswith("OBJECT"), F.lit(False))
    member = lambda name: F.when(nested, F.try_variant_get(cause, f"$.{name}", "string"))
    return F.struct(
        F.coalesce(F.try_variant_get(parsed, "$.message", "string"), error).alias("error"),
        F.try_variant_get(parsed, "$.name", "string").alias("name"),
        F.when(nested, member("message")).otherwise(F.try_variant_get(parsed, "$.cause", "string")).alias("cause_message"),
        member("name").alias("cause_name"),
        member("code").alias("cause_code"),
    )
