"""What the registered queries share: tables, the view of `documents` as stored files, and its SQL twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.patterns import WS_RE2

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for files that a query writes and reads back: below spark.checkpoint.dir, which all executors share; it goes when Spark's JVM ends.

    Only a local session that names none gets a temporary folder of its own.
    """
    context, shared = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="paperloom-")
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/files"


def iso(ts: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stored files: id, filename, text, created_at (a fixed spread of times)."""
    docs = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") * 7919) % 1_000_003)
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), "text", "lang", created.alias("created_at"))


STORED_SQL = "stored AS (SELECT doc_id AS id, source AS filename, text, lang, make_timestamp((1700000000 + (doc_id * 7919) % 1000003) * 1000000) AS created_at FROM documents)"


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[{WS_RE2}]+', ' ', 'g'), ' ')"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{WS_RE2}]+'), lambda w: w <> '')"


def tokens_sql(chars: str) -> str:
    return f"ceil({chars} / 3.5::DOUBLE)::BIGINT"


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal relation of a few rows, in one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({columns})"
