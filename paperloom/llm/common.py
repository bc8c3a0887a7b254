"""What the training-data operators share: word pattern, table reading, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the inside of a character class (valid for Java and for DuckDB).
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads a table through Spark only, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a local session that names none gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a table in the run's own folder below the shared one, which goes when Spark's JVM ends."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/paperloom-{context.applicationId}")
    fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/{label}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df once as Parquet to the shared folder and reads it back.

    Cuts the lineage: lost executors don't bring the work before this point back,
    and readers of a few columns read only those.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that spread_join() takes for hot.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """rows joined to lookup, which has one row per key with the key's number of rows as `weight`.

    The HOT_KEYS heaviest keys, a fixed number of lookup rows, are broadcast, so their rows stay
    where they are; any other key has at most 1 / HOT_KEYS of all rows.
    """
    hot = F.broadcast(lookup.orderBy(F.desc(weight), key).limit(HOT_KEYS))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup, key)
    return rows.join(hot, key).unionByName(cold)
