"""Stored relations: schemas, versions, insert, update, cascade delete, upsert, newest per key.

Parquet has no row updates. A table is a folder of versions (`version=N`); a change writes the next
version and readers take the newest, so a reader never sees half a change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = "id string, filename string, original_path string, mime_type string, file_size bigint, page_count int, word_count int, detected_language string, extracted_text string, thumbnail_path string, created_at timestamp, updated_at timestamp"
ANALYSES = "id string, document_id string, mode string, prompt string, result string, structured_result string, model_used string, duration_ms bigint, created_at timestamp"
CHAT_MESSAGES = "id string, document_id string, role string, content string, model_used string, created_at timestamp"
FIRST_IMPRESSIONS = "document_id string, document_type string, recommended_mode string, first_impression string, model_used string, created_at timestamp"
#: Child tables of documents and their key to it.
CHILDREN = {"analyses": "document_id", "chat_messages": "document_id", "first_impressions": "document_id"}


def write_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version:06d}")


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of folders <prefix><number> in path that are complete."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done) or []
    return [int(s.getPath().getParent().getName().removeprefix(prefix)) for s in found]


def newest_version(spark: SparkSession, path: str) -> int:
    """Found from the names of folders whose write has come to its end, without reading rows; 0 if there is none."""
    return max(_numbered(spark, path, "version="), default=0)


def read_newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    version = newest_version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={version:06d}") if version else spark.createDataFrame([], schema)


def create_tables(spark: SparkSession, database: str, buckets: int = 64) -> None:
    """The four relations as Parquet tables. In place of indexes, children are bucketed by document and sorted by time."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    tables = {"documents": (DOCUMENTS, "id"), "analyses": (ANALYSES, "document_id"), "chat_messages": (CHAT_MESSAGES, "document_id"), "first_impressions": (FIRST_IMPRESSIONS, "document_id")}
    for name, (columns, key) in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY (created_at) INTO {buckets} BUCKETS")


def insert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Current rows and new ones, matched by column name; columns that new rows lack are null."""
    return current.unionByName(new, allowMissingColumns=True).select(*current.columns)


def append(new: DataFrame, path: str) -> None:
    """Adds rows to a table's folder; what lies there isn't read or rewritten."""
    new.write.mode("append").parquet(path)


def migrate(df: DataFrame, version: int, steps: list) -> tuple[DataFrame, int]:
    """Applies the steps after `version` in order; step n leads to version n. A newest version is left alone."""
    return reduce(lambda at, step: (step(at[0]), at[1] + 1), steps[version:], (df, version))


def schema_version(spark: SparkSession, path: str) -> int:
    """The highest number among a table's version markers; 0 for a table that has none yet."""
    return max(_numbered(spark, path, "schema-"), default=0)


def run_migrations(spark: SparkSession, path: str, steps: list) -> int:
    """Brings the table of versions in path to the newest schema, one step at a time; returns its version.

    Markers (schema-<n>) say which version of the rows has schema n; none is ever rewritten. A step starts
    from the newest marker's rows, writes the next version and then its marker, so one that fails at any
    place is done over from the same rows. From step 2 on, the rows before the step are kept as backup-<version>.
    """
    marked = lambda number, version: spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema-{number}")
    if not _numbered(spark, path, "schema-"):
        marked(0, newest_version(spark, path))
    at = schema_version(spark, path)
    for step in steps[at:]:
        version = spark.read.parquet(f"{path}/schema-{at}").first()["version"]
        rows = spark.read.parquet(f"{path}/version={version:06d}")
        if at:
            rows.write.mode("overwrite").parquet(f"{path}/backup-{at}")
        write_version(step(rows), path, version + 1)
        at += 1
        marked(at, version + 1)
    return at


def update(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of current with the columns of changes (one row a key) where those aren't null; other rows and columns stay."""
    renamed = changes.select(F.col(key).alias("changed_key"), *[F.col(c).alias(f"changed_{c}") for c in changes.columns if c != key])
    joined = current.join(renamed, F.col(key) == F.col("changed_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"changed_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in current.columns])


def delete_cascade(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables without deleted keys (one column, named like the parent's); unknown keys do nothing."""
    gone = deleted.select(F.col(key).alias("gone_key")).distinct()
    drop = lambda df, column: df.join(gone, F.col(column) == F.col("gone_key"), "left_anti")
    return {"parent": drop(parent, key)} | {name: drop(df, column) for name, (df, column) in children.items()}


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows as they are, and new rows whose key is new."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def newest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def finished(result: Column, aborted: Column, mark: str = "[stopped]") -> Column:
    """A stored answer: aborted ones carry a mark."""
    return F.when(aborted, F.concat(result, F.lit(f"\n\n{mark}"))).otherwise(result)


#: Parts of a table that is changed part by part.
PARTS = 64


def part_of(key: Column, parts: int = PARTS) -> Column:
    """The part that a key's rows lie in."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def write_parts(df: DataFrame, path: str, key: str, parts: int = PARTS, mode: str = "errorifexists") -> None:
    """Writes a table in folders by a hash of its key; a part that one key fills is still written by many tasks."""
    rows = df.withColumn("part", part_of(F.col(key), parts)).hint("rebalance", F.col("part"))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def touched_parts(keys: DataFrame, key: str, parts: int = PARTS) -> list[int]:
    """The parts that some keys lie in: PARTS numbers at most, however many keys there are."""
    return sorted(r[0] for r in keys.select(part_of(F.col(key), parts)).distinct().collect())


def read_parts(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a table in parts, or of some parts; others aren't listed or read."""
    rows = spark.read.schema(f"{schema}, part int").parquet(path)
    return (rows if only is None else rows.where(F.col("part").isin(only))).drop("part")


def _replaced(spark: SparkSession, path: str, rows: DataFrame, key: str, only: list[int], parts: int) -> list[int]:
    """Puts rows in the place of the parts `only`, and takes away those that are left empty."""
    kept = set(touched_parts(rows, key, parts))
    write_parts(rows, path, key, parts, "overwrite")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in set(only) - kept:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}"), True)
    return only


def update_parts(spark: SparkSession, path: str, schema: str, changes: DataFrame, key: str, parts: int = PARTS) -> list[int]:
    """update() of a table in parts: reads and rewrites the changed keys' parts only; returns them. Run again, it gives the same table."""
    only = touched_parts(changes, key, parts)
    return _replaced(spark, path, update(read_parts(spark, path, schema, only), changes, key), key, only, parts) if only else []


def delete_parts(spark: SparkSession, tables: dict[str, tuple[str, str, str]], deleted: DataFrame, parts: int = PARTS) -> dict[str, list[int]]:
    """delete_cascade() of tables in parts, each (path, schema, key to the deleted ids): the deleted keys' parts of each table are rewritten; returns them."""
    gone = deleted.toDF("gone_key").distinct()
    only, out = touched_parts(gone, "gone_key", parts), {}
    for name, (path, schema, key) in tables.items():
        rows = read_parts(spark, path, schema, only)
        out[name] = _replaced(spark, path, rows.join(gone, F.col(key) == F.col("gone_key"), "left_anti"), key, only, parts) if only else []
    return out


def insert_absent_parts(spark: SparkSession, path: str, schema: str, new: DataFrame, key: str, parts: int = PARTS) -> None:
    """insert_absent() of a table in parts: existing keys are read of the new keys' parts only, and nothing is rewritten."""
    existing = read_parts(spark, path, schema, touched_parts(new, key, parts)).select(key)
    write_parts(new.join(existing, key, "left_anti"), path, key, parts, "append")


def write_sorted(df: DataFrame, path: str, by: list[str], lookups: dict[str, int]) -> None:
    """Writes a table sorted by ranges of some columns, with Bloom filters on others (column: distinct values in a file, about).

    Statistics of row groups skip what lies beside a range of `by`, Bloom filters what doesn't hold a value looked up.
    """
    writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write
    for column, distinct in lookups.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    writer.parquet(path)


def look_up(spark: SparkSession, path: str, schema: str, column: str, value) -> DataFrame:
    """The rows with a value in a column, as a filter that the scan takes."""
    return spark.read.schema(schema).parquet(path).where(F.col(column) == F.lit(value))
