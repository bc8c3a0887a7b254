"""Keyed stream state with timers and expiry (transformWithState), and a sink that takes each batch once.

State lies in RocksDB, so it isn't bounded by an executor's heap: call use_rocksdb() before a query starts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from paperloom.functions.patterns import FLUSH_MS
from paperloom.operators.monitoring import Flusher, load_percent

#: How long a silent stream or host is remembered.
SILENT_MS = 3_600_000

BATCH = "stream long, batch long, text string, final boolean"
LOAD = "host long, sample long, load long"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FlushProcessor(StatefulProcessor):
    """The flush rule of one chunk stream.

    What is pending is held chunk by chunk, so that a chunk is an append and not a rewrite. A timer
    flushes what has waited FLUSH_MS since the last chunk. An ended stream is remembered as such: a chunk that
    comes late is a final batch of its own with the next number. A second timer forgets a stream that has
    been silent for silent_ms with nothing pending; an expiry of the state itself could take pending text with it.
    """

    def __init__(self, silent_ms: int | None = SILENT_MS):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "chars long, last_ms double, batch long, ended boolean")
        self.pending = handle.getListState("pending", "text string")

    def _taken(self) -> str:
        text = "".join(row[0] for row in self.pending.get())
        self.pending.clear()
        return text

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A call to the state is a round trip: each part is asked for once, and only if it matters.
        chars, last, batch, ended = self.place.get() or (0, -1.0, 0, False)
        out, fresh, held = [], [], chars > 0
        for row in sorted(rows, key=lambda r: (r["seq"] is None, r["seq"] or 0)):
            ms, text = math.nan if row["ms"] is None else float(row["ms"]), row["text"] or ""
            flusher = Flusher(int(chars), None if last < 0 else last, int(batch))
            flusher.take(len(text), ms)
            if text:
                fresh.append(text)
            ended, last = ended or bool(row["end"]), flusher.last
            chars = chars + len(text)
            if flusher.batch > batch or (ended and chars):
                out.append(_batch(key[0], batch, (self._taken() if held else "") + "".join(fresh), ended))
                chars, batch, fresh, held = 0, batch + 1, [], False
        if fresh:
            self.pending.appendList([(text,) for text in fresh])
        self.place.update((int(chars), float(last), int(batch), bool(ended)))
        if self.silent_ms is not None:
            self._set_timer(timerValues, chars)
        yield from out

    def _set_timer(self, timerValues, chars: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + (FLUSH_MS if chars else self.silent_ms))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        chars, last, batch, ended = self.place.get()
        if chars:
            self.place.update((0, float(last) + FLUSH_MS, int(batch) + 1, bool(ended)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
            yield _batch(key[0], batch, self._taken(), ended)
        else:
            self.place.clear()


def _batch(stream: int, batch: int, text: str, final: bool) -> Row:
    return Row(stream=stream, batch=int(batch), text=text, final=bool(final))


def _time_mode(silent_ms: int | None) -> str:
    return "None" if silent_ms is None else "ProcessingTime"


def flush_chunks(chunks: DataFrame, silent_ms: int | None = SILENT_MS) -> DataFrame:
    """From a stream of (stream, seq, ms, text, end): batches of text as they fill up, get late or end. Within a micro-batch chunks go by seq.

    With silent_ms None there are no timers and nothing is forgotten; only then does a query with an
    availableNow trigger come to its end.
    """
    return chunks.groupBy("stream").transformWithState(FlushProcessor(silent_ms), BATCH, "Append", _time_mode(silent_ms))


class LoadProcessor(StatefulProcessor):
    """The load of one host from differences of its cores' counters to the sample before.

    A micro-batch tells the load of each sample that it holds cores of; a sample whose cores come in
    several micro-batches is told again, and the last word holds. Samples come in order; cores of a sample
    before the newest are late and change nothing but their own core's last reading, if they are newer.
    """

    def __init__(self, silent_ms: int | None = SILENT_MS):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cores = handle.getMapState("cores", "core long", "sample long, total double, idle double", self.silent_ms)
        self.newest = handle.getValueState("newest", "sample long, d_total double, d_idle double", self.silent_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sample, d_total, d_idle = self.newest.get() or (None, 0.0, 0.0)
        # A call to the state is a round trip: a core's last reading is asked for and told once, not by row.
        told, readings, changed = {}, {}, set()
        for at, core, total, idle in pd.concat(list(rows)).sort_values(["sample", "core"])[["sample", "core", "total", "idle"]].itertuples(index=False):
            if core not in readings:
                readings[core] = self.cores.getValue((int(core),))
            before = readings[core]
            if before and before[0] >= at:
                continue
            readings[core] = (int(at), float(total), float(idle))
            changed.add(core)
            if sample is None or at > sample:
                sample, d_total, d_idle = int(at), 0.0, 0.0
            if at == sample:
                if before:
                    d_total, d_idle = d_total + float(total) - before[1], d_idle + float(idle) - before[2]
                told[sample] = load_percent(d_total, d_idle)
        for core in changed:
            self.cores.updateValue((int(core),), readings[core])
        if sample is not None:
            self.newest.update((int(sample), d_total, d_idle))
        yield pd.DataFrame([(key[0], s, load) for s, load in told.items()], columns=["host", "sample", "load"])


def cpu_load_stream(samples: DataFrame, silent_ms: int | None = SILENT_MS) -> DataFrame:
    """From a stream of (host, sample, core, total, idle): the load of each host and sample in per cent, 0 for a host's first, as cpu_load() tells it of a table.

    With silent_ms None, hosts are never forgotten.
    """
    return samples.groupBy("host").transformWithStateInPandas(LoadProcessor(silent_ms), LOAD, "Update", _time_mode(silent_ms))


def take_once(path: str, file_format: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes a batch to a folder named after its query and number.

    A batch that is replayed after a failure replaces its own folder, so nothing is written twice. The
    query is known by its checkpoint's id: one that starts over with a new checkpoint writes beside the old rows.
    """

    def take(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        batch.write.mode("overwrite").format(file_format).save(f"{path}/query_id={query}/batch_no={number}")

    return take


def once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", file_format: str = "parquet") -> DataStreamWriter:
    """A writer of a stream's batches to path, each once; read them with taken()."""
    return stream.writeStream.outputMode(mode).foreachBatch(take_once(path, file_format)).option("checkpointLocation", checkpoint)


def taken(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """The rows that once() has written, with their query and batch; folders whose write hasn't come to its end are left out."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(s.getPath().getParent()) for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/query_id=*/batch_no=*/_SUCCESS")) or []]
    if not done:
        return spark.createDataFrame([], f"{schema}, query_id string, batch_no long")
    return spark.read.schema(f"{schema}, query_id string, batch_no long").option("basePath", path).format(file_format).load(done)
