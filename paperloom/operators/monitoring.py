"""Logs and host metrics: level checks, size caps, retention, load, running streams, chunk batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.classify import round_half_up
from paperloom.functions.patterns import FLUSH_CHARS, FLUSH_MS, LOG_FILES
from paperloom.operators import prefix

LEVELS = ("debug", "info", "warn", "error")
CHECK_EVERY = 200


def valid_entry(level: Column, source: Column, message: Column) -> Column:
    return F.coalesce(level.isin(*LEVELS), F.lit(False)) & source.isNotNull() & message.isNotNull()


def log_line(ts: Column, level: Column, source: Column, message: Column, meta: Column) -> Column:
    """One JSON line; meta is left out if null."""
    return F.to_json(F.struct(ts.alias("ts"), level.alias("lvl"), source.alias("src"), message.alias("msg"), meta.alias("meta")))


def write_logs(entries: DataFrame, path: str) -> None:
    """Appends accepted entries (ts, level, source, message, meta) as JSON lines, a folder a UTC day."""
    ok = entries.where(valid_entry(F.col("level"), F.col("source"), F.col("message")))
    lines = ok.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", F.col("level").alias("lvl"), F.col("source").alias("src"), F.col("message").alias("msg"), "meta")
    lines.write.mode("append").partitionBy("day").json(path)


def ram_usage(total: Column, free: Column) -> Column:
    """struct(total_gb, used_gb, used_percent)."""
    used = total - free
    gigabytes = lambda size: F.round(size / (1024 * 1024 * 1024), 1)
    return F.struct(gigabytes(total).alias("total_gb"), gigabytes(used).alias("used_gb"), round_half_up(used / total * 100).cast("long").alias("used_percent"))


def capped(lines: DataFrame, day: str, order: list[str], size: Column, most: int, path: str, every: int = CHECK_EVERY) -> DataFrame:
    """Lines that a day's file takes: at each `every`-th line the bytes so far are checked, and past the cap the rest is dropped.

    A day may hold any share of the lines: its sums come from prefix.running(), which writes them to path.
    """
    rows = prefix.running(lines.withColumn("line_size", size.cast("long")), [day], order, F.col("line_size"), path)
    rows = rows.withColumn("bytes_before", F.col("running") - F.col("line_size"))
    over = rows.where((F.col("line_no") % every == 0) & (F.col("bytes_before") > most)).groupBy(F.col(day).alias("full_day")).agg(F.min("line_no").alias("full_at"))
    kept = rows.join(over, F.col(day).eqNullSafe(F.col("full_day")), "left").where(F.col("full_at").isNull() | (F.col("line_no") < F.col("full_at")))
    return kept.select(*lines.columns, "line_no", "bytes_before")


def kept_files(files: DataFrame, most: int = LOG_FILES) -> DataFrame:
    """The newest files by (mtime, name)."""
    return files.orderBy(F.desc("mtime"), "name").limit(most)


def load_percent(d_total: float, d_idle: float) -> int:
    """A load from the differences of counters, as cpu_load() has it."""
    return max(0, min(100, math.floor((d_total - d_idle) / d_total * 100 + 0.5))) if d_total > 0 else 0


def cpu_load(samples: DataFrame) -> DataFrame:
    """From (host, sample, core, total, idle): load per host and sample in per cent, from differences to the sample before; 0 for the first."""
    before = Window.partitionBy("host", "core").orderBy("sample")
    deltas = samples.select("host", "sample", (F.col("total") - F.lag("total").over(before)).alias("d_total"), (F.col("idle") - F.lag("idle").over(before)).alias("d_idle"))
    total, idle = F.sum("d_total"), F.sum("d_idle")
    load = F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), round_half_up((total - idle) / total * 100)))).otherwise(0)
    return deltas.groupBy("host", "sample").agg(load.cast("long").alias("load"))


def active_streams(events: DataFrame, key: str, order: list[str], step: Column) -> DataFrame:
    """Running count of started less ended streams that never falls below zero.

    With P the plain running sum, the floored one is P - min(0, the least P so far).
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("plain", F.sum(step).over(so_far))
    return summed.withColumn("active", F.col("plain") - F.least(F.lit(0), F.min("plain").over(so_far))).drop("plain")


def active_streams_total(events: DataFrame, order: list[str], step: Column, path: str) -> DataFrame:
    """The gauge of active_streams() over all streams as one sequence, by prefix.running(), which writes to path."""
    summed = prefix.running(events, [], order, step, path)
    return summed.select(*events.columns, (F.col("running") - F.least(F.lit(0), F.col("least"))).alias("active"))


class Flusher:
    """Pending characters and the time of the last flush of one stream."""

    def __init__(self, pending: int = 0, last: float | None = None, batch: int = 0):
        self.pending, self.last, self.batch = pending, last, batch

    def take(self, chars: int, ms: float) -> int:
        """The batch that a chunk belongs to; the batch closes if it is full or late enough. Time starts at the first chunk."""
        self.last = ms if self.last is None else self.last
        self.pending += chars
        own = self.batch
        if chars and (self.pending >= FLUSH_CHARS or ms - self.last >= FLUSH_MS):
            self.pending, self.last, self.batch = 0, ms, self.batch + 1
        return own


def flush_batches(chunks: DataFrame) -> DataFrame:
    """From (stream, seq, ms, chars): adds the batch of each chunk.

    The rule carries state from chunk to chunk. Streams are dealt out by key and sorted inside each
    partition, and a partition is read once, batch by batch, so a long stream never lies in memory whole.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, Flusher()
        for frame in frames:
            out = []
            for key, chars, ms in zip(frame["stream"], frame["chars"], frame["ms"], strict=True):
                if key != stream:
                    stream, state = key, Flusher()
                out.append(state.take(int(chars), float(ms)))
            yield frame.assign(batch=pd.Series(out, dtype="int64", index=frame.index))

    rows = chunks.select("stream", "seq", "ms", "chars").repartition("stream").sortWithinPartitions("stream", "seq")
    return rows.mapInPandas(batches, rows._jdf.schema().toDDL() + ", batch long")


def stream_digests(chunks: DataFrame) -> DataFrame:
    """From (stream, seq, piece): per stream the md5 of its pieces joined in order, null ones left out, and its number of chunks.

    Read like flush_batches: the digest takes a piece at a time, so no stream is one row or string.
    """

    def digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, md5, n = None, hashlib.md5(), 0

        def row(kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([stream], kind), pa.array([md5.hexdigest()]), pa.array([n], pa.int64())], ["stream", "digest", "chunks"])

        kind = None
        for frame in frames:
            kind = frame.schema.field("stream").type
            for key, piece in zip(frame.column("stream").to_pylist(), frame.column("piece").to_pylist(), strict=True):
                if n and key != stream:
                    yield row(kind)
                    md5, n = hashlib.md5(), 0
                stream, n = key, n + 1
                md5.update((piece or "").encode())
        if n:
            yield row(kind)

    rows = chunks.select("stream", "seq", "piece").repartition("stream").sortWithinPartitions("stream", "seq", "piece")
    return rows.mapInArrow(digests, rows.select("stream")._jdf.schema().toDDL() + ", digest string, chunks long")
